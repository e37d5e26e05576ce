"""Encoding and decoding with merge-type SentencePiece vocabularies.

Encoding keeps an agenda of adjacent symbol pairs ordered by the score of the
piece they make (ties: leftmost first); the best pair merges, its new
neighbours enter the agenda.  Short segments have theirs as rows of one table
and advance side by side, a long one has a heap.  Characters that end as no
piece become byte pieces.

A text is first cut where no piece of the vocabulary can span: before a space
mark, and between letters and the rest.  Merges never cross such a cut, so
each segment is encoded and decoded by itself and remembered; the property is
checked against the vocabulary when it is loaded, and without it texts stay
whole.  Every new segment of an Arrow batch is also encoded and decoded by the
sentencepiece library and the two must agree.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
#: Space marks and what follows them up to the next cut.
#: (Superscripts and fractions count with the rest.)
SEGMENT = re.compile(f"{SPACE}*[^\\W\\d_¹²³¼-¾]+|{SPACE}*(?:[^\\w{SPACE}]|[\\d_¹²³¼-¾])+|{SPACE}+")
WHOLE = re.compile(r"(?s).+")
#: Segments and their characters in one of a worker's two memories: when the younger is full, it becomes the elder and
#: the elder is given up, so segments met since then stay known.
REMEMBERED = 200_000
REMEMBERED_CHARS = 4_000_000
#: Segments of so many characters at most are encoded side by side, so many at once.
SHORT, TOGETHER = 48, 4096
#: The rank of a pair that makes no piece.
NEVER = 1 << 40


class Vocabulary:
    """Pieces and scores of a model file, with the agenda and the memory of segments."""

    def __init__(self, path: str) -> None:
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.vocab_size()
        self.ids = {}
        scores = {}
        self.bytes = [0] * 256
        self.decoded = [""] * size
        self.byte_of: dict[int, int] = {}
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.byte_of[i] = int(piece[3:5], 16)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece] = i
                scores[piece] = sp.get_score(i)
                self.decoded[i] = piece.replace(SPACE, " ")
        place = {score: k for k, score in enumerate(sorted(set(scores.values()), reverse=True))}
        #: Place of each piece's score, best first; equal scores share one.
        self.ranks = {piece: place[score] for piece, score in scores.items()}
        self.byte_ids = frozenset(self.byte_of)
        self.number_symbols()
        self.cut = SEGMENT if all(len(SEGMENT.findall(p)) == 1 for p in self.ids) else WHOLE
        # this prefix keeps the library from putting a space mark before a segment; no piece holds a line break
        self.guarded = not any("\n" in p for p in self.ids)
        self.prefix = sp.encode("\n")
        #: Ids of segments, joined by commas; the decoded text only of those that do not decode to themselves.
        self.memory: dict[str, str] = {}
        self.elder: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        self.held = 0

    def segments(self, text: str) -> list[str]:
        return self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def number_symbols(self) -> None:
        """Numbers for pieces and their characters, and the table of pairs (left, right) that make a piece."""
        chars = sorted({c for piece in self.ids for c in piece if c not in self.ids})
        names = [*self.ids, *chars]
        number = {name: k for k, name in enumerate(names)}
        self.n_symbols = len(names)
        self.of_char = np.arange(self.n_symbols, self.n_symbols + 0x110000, dtype=np.int64)  # characters of no piece come after the symbols
        for name, k in number.items():
            if len(name) == 1:
                self.of_char[ord(name)] = k
        pairs = [(number[a], number[b], k, self.ranks[piece]) for k, piece in enumerate(self.ids) for at in range(1, len(piece)) if (a := piece[:at]) in number and (b := piece[at:]) in number]
        table = np.array(pairs, np.int64).reshape(-1, 4)
        keys = table[:, 0] << 32 | table[:, 1]
        order = np.argsort(keys)
        self.pair_keys, self.pair_made, self.pair_rank = (np.append(x[order], y) for x, y in ((keys, -1), (table[:, 2], -1), (table[:, 3], NEVER)))
        self.symbol_ids = [[self.ids[x]] if x in self.ids else [self.bytes[b] for b in x.encode()] for x in names]

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places of pairs in the table; its last row stands for pairs that make no piece."""
        key = a << 32 | b
        at = np.searchsorted(self.pair_keys[:-1], key)
        return np.where(self.pair_keys[at] == key, at, len(self.pair_keys) - 1)

    def encode_side_by_side(self, segments: list[str]) -> list[list[int]]:
        """Ids of many short segments: each row is a segment's agenda, the ranks of its adjacent pairs by place.

        In every step each row pops its best entry (of equal ones the leftmost),
        merges the pair, and enters the ranks of the two new pairs beside it.
        """
        n, sizes = len(segments), np.array([len(s) for s in segments])
        width = int(sizes.max())
        filled = np.arange(width) < sizes[:, None]
        symbol = np.full((n, width + 1), -1, np.int64)
        symbol[:, :width][filled] = self.of_char[np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), "<u4")]
        after, before = np.tile(np.arange(1, width + 2), (n, 1)), np.tile(np.arange(-1, width), (n, 1))
        entry = np.full((n, width), len(self.pair_keys) - 1)
        both = filled[:, :-1] & filled[:, 1:]
        entry[:, :-1][both] = self.pair(symbol[:, : width - 1][both], symbol[:, 1:width][both])
        agenda = self.pair_rank[entry]
        rows = np.arange(n)
        while len(rows):
            at = agenda[rows].argmin(axis=1)
            going = agenda[rows, at] != NEVER
            rows, at = rows[going], at[going]
            gone, left = after[rows, at], before[rows, at]
            right = after[rows, gone]
            made = self.pair_made[entry[rows, at]]
            symbol[rows, at], after[rows, at], agenda[rows, gone] = made, right, NEVER
            symbol[rows, gone] = -1
            entry[rows, at] = self.pair(made, symbol[rows, np.minimum(right, width)])
            agenda[rows, at] = self.pair_rank[entry[rows, at]]
            has = np.flatnonzero(right < width)
            before[rows[has], right[has]] = at[has]
            has = np.flatnonzero(left >= 0)
            r, h = rows[has], left[has]
            entry[r, h] = self.pair(symbol[r, h], made[has])
            agenda[r, h] = self.pair_rank[entry[r, h]]
        live = symbol >= 0
        flat, ends = symbol[live].tolist(), np.cumsum(live.sum(axis=1)).tolist()
        known, ids = self.symbol_ids, []
        every = [known[x] if x < self.n_symbols else [self.bytes[b] for b in chr(x - self.n_symbols).encode()] for x in flat]
        for first, end in zip([0, *ends], ends):
            ids.append([i for own in every[first:end] for i in own])
        return ids

    def encode_segments(self, segments: list[str]) -> list[list[int]]:
        """Ids of segments: short ones side by side, those of like length together, long ones by a heap."""
        out: list[list[int]] = [[]] * len(segments)
        short = sorted((k for k, s in enumerate(segments) if len(s) <= SHORT), key=lambda k: len(segments[k]))
        for at in range(0, len(short), TOGETHER):
            part = short[at : at + TOGETHER]
            for k, ids in zip(part, self.encode_side_by_side([segments[k] for k in part])):
                out[k] = ids
        for k, s in enumerate(segments):
            if len(s) > SHORT:
                out[k] = self.encode_segment(s)
        return out

    def encode_segment(self, segment: str) -> list[int]:
        """Ids of one segment by a heap: entries are rank * n + place, so the best score comes first and of equal ones the leftmost."""
        rank_of = self.ranks.get
        symbols = list(segment)
        n = len(symbols)
        agenda = [rank * n + i for i in range(n - 1) if (rank := rank_of(symbols[i] + symbols[i + 1])) is not None]
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heapq.heapify(agenda)
        while agenda:
            rank, i = divmod(heapq.heappop(agenda), n)
            j = right[i]
            if j < 0 or rank_of(pair := symbols[i] + symbols[j]) != rank:
                continue  # one of its symbols is gone, or has grown
            symbols[i], symbols[j] = pair, ""
            k, h = right[j], left[i]
            right[i], right[j] = k, -1
            if k >= 0:
                left[k] = i
                if (wider := rank_of(pair + symbols[k])) is not None:
                    heapq.heappush(agenda, wider * n + i)
            if h >= 0 and (wider := rank_of(symbols[h] + pair)) is not None:
                heapq.heappush(agenda, wider * n + h)
        out = []
        for s in symbols:
            if s:
                found = self.ids.get(s)
                out += [self.bytes[b] for b in s.encode()] if found is None else [found]
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ``ids``, with the space that begins it still there."""
        if self.byte_ids.isdisjoint(ids):
            return "".join([self.decoded[i] for i in ids])
        out, raw = [], bytearray()
        for i in ids:
            byte = self.byte_of.get(i)
            if byte is None:
                if raw:
                    out.append(raw.decode("utf-8", "replace"))
                    raw.clear()
                out.append(self.decoded[i])
            else:
                raw.append(byte)
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def learn(self, segments: set[str]) -> None:
        """Encode segments by the agenda, decode them, hold both against the library, remember them."""
        self.held += sum(map(len, segments))
        new = list(segments)
        own = self.encode_segments(new)
        texts = [self.decode(ids) for ids in own]
        if self.guarded:
            at = len(self.prefix)
            theirs = self.library.encode(["\n" + s for s in new], num_threads=1)
            back = self.library.decode(theirs, num_threads=1)
            for s, a, b, text, said in zip(new, own, theirs, texts, back):
                if a != b[at:]:
                    raise ValueError(f"the library encodes {s[:80]!r} otherwise: {a[:20]} and {b[at:][:20]}")
                if "\n" + text != said:
                    raise ValueError(f"the library decodes {s[:80]!r} otherwise: {text[:80]!r} and {said[1:81]!r}")
        for s, ids, text in zip(new, own, texts):
            self.memory[s] = ",".join(map(str, ids))
            if text != s.replace(SPACE, " "):
                self.odd[s] = text

    def encode_many(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """For each text: number of ids, the ids joined by commas, and the decoded text."""
        out = []
        for at in range(0, len(texts), 64):  # a few texts at a time: their segments bound what is held
            if len(self.memory) > REMEMBERED or self.held > REMEMBERED_CHARS:
                self.elder, self.memory, self.held = self.memory, {}, 0
                self.odd = {s: text for s, text in self.odd.items() if s in self.elder}
            cut = [self.segments(t or "") for t in texts[at : at + 64]]
            memory, elder, new = self.memory, self.elder, set()
            for s in set().union(*cut).difference(memory):
                ids = elder.get(s)
                if ids is None:
                    new.add(s)
                else:
                    memory[s] = ids
                    self.held += len(s)
            if new:
                self.learn(new)
            for segments in cut:
                ids = ",".join([memory[s] for s in segments])
                odd = self.odd and not self.odd.keys().isdisjoint(segments)
                text = "".join([self.odd.get(s) or s.replace(SPACE, " ") for s in segments]) if odd else "".join(segments).replace(SPACE, " ")
                out.append((ids.count(",") + 1 if ids else 0, ids, text.removeprefix(" ")))
        return out


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once by each worker."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_texts: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Per row: ``id_col``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``; with ``with_texts`` also ``ids`` and ``decoded``.

    Null and empty texts have no ids and decode to nothing.  Rows may repeat,
    ids may be null, columns other than ``carry`` are not read.
    """
    keep = [id_col, *(carry or [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from flowlens.llm import pieces  # the worker's own module, whose memory outlives a task

        vocab = pieces.vocabulary(path)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                found = vocab.encode_many(part.column(len(keep)).to_pylist())
                arrays = [pa.array([f[0] for f in found], pa.int64()), *(pa.array([hashlib.sha256(f[k].encode()).hexdigest() for f in found], pa.string()) for k in (1, 2))]
                if with_texts:
                    arrays += [pa.array([[int(x) for x in f[1].split(",") if x] for f in found], pa.list_(pa.int32())), pa.array([f[2] for f in found], pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), *arrays], schema.names)

    schema = docs.select(*keep).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_texts:
        schema = schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")
    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, schema)
