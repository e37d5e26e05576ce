"""Token counts of byte-level byte-pair vocabularies.

A word's bytes form a linked list of symbols; a heap holds its adjacent pairs
by merge rank.  The lowest rank is popped and merged until no pair is left; the
count is the number of first symbols minus the number of merges, so no token
is ever named.  Words come from the vocabulary's own pattern and are
remembered by the worker, up to a bound.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pattern of byte-level vocabularies that splits text into words.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Words and their characters remembered by a worker; when there are more, it starts afresh.
REMEMBERED = 1_000_000
REMEMBERED_CHARS = 32_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the file: itself, or the next one from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class Merges(dict):
    """Counts of words by the merges of a tokenizer file; looking a new word up counts it."""

    def __init__(self, path: str) -> None:
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(pairs)}
        self.symbols = byte_symbols()
        special = [regex.escape(t["content"]) for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(special)) if special else None
        self.held = 0

    def __missing__(self, word: str) -> int:
        self.held += len(word)
        self[word] = n = self.count_word(word)
        return n

    def count_word(self, word: str) -> int:
        ranks = self.ranks
        symbols = [self.symbols[b] for b in word.encode()]
        n = len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(rank, i) for i, pair in enumerate(zip(symbols, symbols[1:])) if (rank := ranks.get(pair)) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, i = heapq.heappop(heap)
            j = right[i]
            if j < 0 or ranks.get((symbols[i], symbols[j])) != rank:
                continue
            symbols[i], symbols[j] = symbols[i] + symbols[j], ""
            merges += 1
            k, h = right[j], left[i]
            right[i] = k
            right[j] = -1
            if k >= 0:
                left[k] = i
                if (near := ranks.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (near, i))
            if h >= 0 and (near := ranks.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (near, h))
        return n - merges

    def count(self, text: str | None) -> int:
        """Tokens of a text; a special token's string in it is one token."""
        if not text:
            return 0
        if len(self) > REMEMBERED or self.held > REMEMBERED_CHARS:
            self.clear()
            self.held = 0
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(sum(map(self.__getitem__, PATTERN.findall(p))) for p in parts)
        return sum(map(self.__getitem__, PATTERN.findall(text)))


_loaded: dict[str, Merges] = {}


def merges(path: str) -> Merges:
    """The merges of a file, read once by each worker."""
    if path not in _loaded:
        _loaded[path] = Merges(path)
    return _loaded[path]


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    Null and empty texts count 0.  Rows may repeat, ids may be null, other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from flowlens.llm import bpe  # the worker's own module, whose memory outlives a task

        counter = bpe.merges(path)
        for b in batches:
            counts, sizes = [], []
            for t in b.column(1):
                text = t.as_py()
                counts.append(counter.count(text))
                sizes.append(len(text.encode()) if text else 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], schema.names)

    schema = docs.select(id_col).schema.add("n_bytes", "long").add("n_tokens", "long")
    return docs.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
