"""Secret scans: base patterns and dictionary-primed zstandard novelty.

A candidate is a long run of key characters next to a sensitive word.  It is
compressed twice with a raw zstandard dictionary made of common identifiers,
some fixed and ``MOST`` learned from the corpus (letters only, from ``FEWEST``
documents or more, so no key is among them), and of the code that surrounds
it, in which whatever looks like a key is blanked out, so that no key is hidden by
a copy of it, nor by another that begins alike: the surroundings
alone, and with the candidate put back.  The difference is its marginal size.  Words, paths and repeated
names cost a few bytes; what can't be predicted from the identifiers or
the surroundings costs nearly its own length in bytes, and is reported; of a
small alphabet, such as digits, a smaller share of the length is enough.  The
lines of a private key's block all stand beside a sensitive word.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import aside

#: The base patterns and the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "novel")

#: Words and beginnings of tokens beside which a candidate is weighed, and common identifiers that never make one new.
CONTEXT = re.compile(r"pass(?:word|wd|phrase)|secret|token|api[\x20_-]?key|access[\x20_-]?key|private[\x20_-]?key|credential|bearer|authorization|signature|auth[\x20_-]?key|\bgh[opsur]_|\bxox[abeprs]-|\bsk_live_|\bglpat-", re.I | re.A)
IDENTIFIERS = (
    "password passwd passphrase secret token api_key apikey access_key private_key credential bearer authorization signature client_id client_secret "
    "refresh_token access_token session_id user_name username account_id public_key begin end certificate request response content_type application "
    "json http https www example localhost config settings environment variable default value string number boolean object function return import from "
    "class static const export module package version release development production testing database connection host port index name description "
    "placeholder changeme your_token_here your_api_key_here xxxxxxxxxxxxxxxx 00000000000000000000 1234567890 abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ /usr/local/bin /usr/share/lib /home/user com.example.application org.example.service"
)
#: In lower case, one of these is in every sensitive word.
CLUES = ("passw", "passp", "secret", "token", "key", "credential", "bearer", "authorization", "signature", "gho_", "ghp_", "ghs_", "ghu_", "ghr_", "xox", "sk_live_", "glpat-")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=~-]{16,}")
#: A private key in armour, up to its end line or the text's end; the short last line that may follow a full one.
BLOCK = re.compile(r"-----BEGIN\x20[A-Z0-9\x20]*PRIVATE\x20KEY[A-Z\x20]*-----.*?(?=-----|\Z)", re.S)
LAST = re.compile(r"\s+([A-Za-z0-9+/=]{1,15})(?=\s*(?:-----END|\Z))")
#: What may not stand between a label and its value on a later line.
LABELLED = re.compile(r"[^\W_]")
REACH = 48
AROUND = 256
NOVELTY = 0.75
#: Identifiers learned, and documents that must hold one.
MOST, FEWEST = 500, 3
#: Names of several words of letters, joined or in camel case.
IDENTIFIER = r"(?<![A-Za-z0-9])(?:[A-Za-z]{2,20}(?:[_.-][A-Za-z]{2,20}){1,4}|[a-z]{2,20}(?:[A-Z][a-z]{2,20}){1,4})(?![A-Za-z0-9])"


def learn(docs: DataFrame, text_col: str = "text", most: int = MOST, fewest: int = FEWEST) -> str:
    """The dictionary: fixed identifiers, then those of most documents, the commonest last.

    Every document counts, a name once in each; ties go by name.
    """
    names = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(IDENTIFIER), F.lit(0)))
    counts = docs.select(F.explode(names).alias("name")).groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") >= fewest)
    top = counts.orderBy(F.desc("n"), "name").limit(most).collect()  # ``most`` names
    return " ".join([IDENTIFIERS, *(r["name"] for r in reversed(top))])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches, leftmost and not overlapping per kind."""
    out = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def marginal_bytes(candidate: str, before: str, after: str, known: str = IDENTIFIERS) -> int:
    """Compressed bytes that ``candidate`` adds to its surroundings, given them and the identifiers ``known`` as dictionary."""
    around = f"{before} {after}".encode("utf-8", "replace")
    primed = zstandard.ZstdCompressionDict(known.encode() + b" " + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    pack = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_dict_id=False).compress
    return len(pack(around + candidate.encode())) - len(pack(around))


def hidden(text: str) -> str:
    """``text`` with every candidate that looks like a key blanked out, in place."""
    return CANDIDATE.sub(lambda m: " " * len(m[0]) if keylike(m[0]) else m[0], text)


def without(value: str, text: str, a: int, b: int) -> tuple[str, str]:
    """The ``AROUND`` characters before ``a`` and after ``b`` of a text of :func:`hidden`, copies of ``value`` blanked out, also those cut by the ends."""
    blank, wide = " " * len(value), AROUND + len(value)
    return text[max(0, a - wide) : a].replace(value, blank)[-AROUND:], text[b : b + wide].replace(value, blank)[:AROUND]


def alphabet_share(value: str) -> float:
    """Bits of a letter of the candidate's alphabet over the 6 of base64, 1 at most."""
    if re.fullmatch("[0-9A-F]+|[0-9a-f]+", value):
        size = 16 if re.search("[A-Fa-f]", value) else 10
    else:
        size = sum(n for n, x in ((10, "[0-9]"), (26, "[a-z]"), (26, "[A-Z]"), (7, "[^0-9A-Za-z]")) if re.search(x, value))
    return min(1.0, math.log2(size) / 6)


def keylike(value: str) -> bool:
    """Letters and digits, digits alone, or letters alone that do not look like words or names of words.

    Compression can't tell a rare word from a key, so letters alone must change
    their case as random ones do, or, of one case, have few vowels.
    """
    if re.search("[0-9]", value):
        return True
    letters = value.rstrip("=")
    if not letters.isalpha():
        return False
    body = letters[1:]
    if body.islower() or body.isupper():
        return 10 * len(re.findall("[aeiouy]", letters, re.I)) < 3 * len(letters)
    return 20 * sum(x.isupper() != y.isupper() for x, y in zip(letters, body)) >= 7 * len(body)


class Marks:
    """Sensitive words of a text and its key blocks, to ask whether a place is beside one."""

    def __init__(self, text: str, spans: list[tuple[int, int]]) -> None:
        self.text, spans = text, sorted(spans)
        self.starts = [a for a, _ in spans]
        self.reach = list(accumulate((b for _, b in spans), max))  # furthest end so far

    def beside(self, a: int, b: int) -> bool:
        """One is on a line of a..b, or within ``REACH`` characters of it, or before it with no letter or digit between, however far."""
        low, high = min(self.text.rfind("\n", 0, a) + 1, a - REACH), self.text.find("\n", b)
        high = max(len(self.text) if high < 0 else high, b + REACH)
        last = bisect_right(self.starts, high) - 1
        if last >= 0 and self.reach[last] >= low:
            return True
        last = bisect_right(self.starts, a) - 1
        return last >= 0 and not LABELLED.search(self.text, self.reach[last], a)


def novel_spans(text: str, taken: list[tuple[int, int, int]], novelty: float = NOVELTY, known: str = IDENTIFIERS) -> list[tuple[int, int, int]]:
    """Candidates beside a sensitive word, outside ``taken``, whose marginal bytes reach ``novelty`` of their length.

    A sensitive word is beside a candidate if it is on the same line, within
    ``REACH`` characters, or the last word before it; in a private key's block it always is.
    """
    low = text.lower()
    if not any(x in low for x in CLUES):
        return []
    blocks = [m.span() for m in BLOCK.finditer(text)] if "-----BEGIN" in text else []
    marks = Marks(text, [m.span() for m in CONTEXT.finditer(text)] + blocks)
    taken, out, t, bare = sorted(taken), [], 0, None
    for m in CANDIDATE.finditer(text) if marks.starts else ():
        a, b = m.span()
        while t < len(taken) and taken[t][0] < b and taken[t][2] <= a:
            t += 1
        if (a and text[a - 1] == "@") or any(s < b and a < e for s, _, e in taken[t : t + 3]):
            continue
        value = m[0]
        inside = any(s <= a < e for s, e in blocks)
        if not (inside or keylike(value)) or not marks.beside(a, b):
            continue
        bare = hidden(text) if bare is None else bare
        if marginal_bytes(value, *without(value, bare, a, b), known) >= novelty * alphabet_share(value) * len(value):
            out.append((a, 3, b))
            last = LAST.match(text, b) if inside else None
            if last:
                out.append((last.start(1), 3, last.end(1)))
    return out


def find(text: str | None, novelty: float = NOVELTY, known: str = IDENTIFIERS) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of a text as (start, kind, end), sorted; null has none."""
    base = sorted(base_spans(text or ""))
    return base, sorted(base + novel_spans(text or "", base, novelty, known))


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redacted(text: str | None, spans: list[tuple[int, int, int]], mark: str) -> str | None:
    """``text`` with every run of overlapping spans replaced by ``mark``."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", novelty: float = NOVELTY, known: str | None = None) -> DataFrame:
    """Per row: ``id_col``, counts of the base kinds and of ``novel``, ``base_sha256`` and ``spans``.

    Null and empty texts have no spans; rows may repeat, ids may be null, other
    columns are not read.  Offsets are code points, ends are exclusive.
    ``known``: the dictionary, learned from ``docs`` if not given.
    """
    kept, known = docs.select(id_col).schema, learn(docs, text_col) if known is None else known

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [find(t.as_py(), novelty, known) for t in b.column(1)]
            counts = [pa.array([sum(k == kind for _, k, _ in every) for _, every in both], pa.int64()) for kind in range(len(KINDS))]
            digest = pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in both], pa.string())
            spans = pa.array([listed(every) for _, every in both], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, digest, spans], [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = kept
    for k in KINDS:
        schema = schema.add(f"n_{k}", "long")
    return docs.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, schema.add("base_sha256", "string").add("spans", "string"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", novelty: float = NOVELTY, known: str | None = None) -> DataFrame:
    """``docs`` with each reported span of the text replaced by ``mark``; ``n_chars``, if there, follows.

    Further columns may have any name and type; they come back as they are.
    """
    place, known = docs.columns.index(text_col), learn(docs, text_col) if known is None else known
    own, names = aside(docs, text_col, "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = (t.as_py() for t in b.column(place))
            clean = pa.array([redacted(t, find(t, novelty, known)[1], mark) for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([clean if k == place else c for k, c in enumerate(b.columns)], names)

    out = own.mapInArrow(run, own.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length(text_col).cast(own.schema["n_chars"].dataType))
    return out.toDF(*docs.columns)
