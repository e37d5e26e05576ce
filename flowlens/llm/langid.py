"""Language identification by multilingual mixture inference.

Each language is a multinomial over hashed character trigrams, mixed with a share of
``SHARED`` of what all languages have in common, so that a trigram that none has seen
is as likely in each, however few texts it was learned from.  For a document,
expectation-maximisation estimates the proportions of all languages from its
trigrams' likelihoods.  Sets of the k likeliest languages are then compared by
log-likelihood less a penalty for each further language; the set grows while
that pays.  The prediction is the largest proportion within the chosen set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 15
BUCKETS = 1 << BITS
SMOOTH = 0.5
#: Part of each language's model that is the common one.
SHARED = 0.05
#: Expectation-maximisation ends when no proportion moves by more than this, or after so many rounds.
SETTLED, ROUNDS = 1e-4, 100
#: A further language must raise the log-likelihood by so many times log(number of trigrams).
PENALTY = 6.0
CHUNK = 1 << 20
UNDETERMINED = "und"


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from learning: crc32 of its id as text, mod 4, is 2; unknown for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def trigrams(text: str) -> np.ndarray:
    """How often each bucket's trigrams occur in a text, lower-cased and with a space at either end."""
    counts = np.zeros(BUCKETS, np.int64)
    text = f" {text.lower()} "
    for at in range(0, len(text) - 2, CHUNK):
        c = np.frombuffer(text[at : at + CHUNK + 2].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        mixed = c[:-2] * np.uint64(0x1000003) + c[1:-1] * np.uint64(0x10FFF) + c[2:]
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        counts += np.bincount((mixed >> np.uint64(64 - BITS)).astype(np.int64), minlength=BUCKETS)
    return counts


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and their log-probabilities (languages, BUCKETS), from all rows that are not held out.

    A language without any letter in its texts is not learned. The model goes through the driver:
    128 KB a language, so the values of ``lang_col`` must be languages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counts in sums.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "bucket", "n"])
            sums.clear()

        for b in batches:
            for text, lang in zip(b.column(0), b.column(1)):
                lang, value = lang.as_py(), text.as_py()
                if lang not in sums and len(sums) >= 64:
                    yield from flush()
                if has_letter(value):
                    sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                    sums[lang] += trigrams(value)
        yield from flush()

    rows = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    sums = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = sums.toArrow()  # languages * BUCKETS rows at most: the model, which grows with the languages only
    langs = sorted(set(got.column("lang").to_pylist()))
    table = np.zeros((len(langs), BUCKETS))
    place = {name: k for k, name in enumerate(langs)}
    if got.num_rows:
        np.add.at(table, (np.array([place[x] for x in got.column("lang").to_pylist()]), got.column("bucket").to_numpy()), got.column("n").to_numpy())
    return langs, log_model(table)


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log-probabilities of the buckets in each language, from its counts (languages, BUCKETS), none of which is all zero."""
    common = counts.sum(axis=0) + SMOOTH
    own = counts / counts.sum(axis=1, keepdims=True)
    return np.log((1 - SHARED) * own + SHARED * common / common.sum()).astype(np.float32)


def proportions(likelihoods: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
    """Mixture proportions by expectation-maximisation, and the log-likelihood reached."""
    share, total = np.full(len(likelihoods), 1 / len(likelihoods)), counts.sum()
    for _ in range(ROUNDS if len(share) > 1 else 0):
        before = share
        share = share * (likelihoods @ (counts / (share @ likelihoods))) / total
        if np.abs(share - before).max() <= SETTLED:
            break
    return share, float(counts @ np.log(share @ likelihoods))


def predict_one(text: str | None, langs: list[str], model: np.ndarray) -> tuple[str, float, list[str]]:
    """(language, its proportion among all languages, chosen set) of a text."""
    if not langs or not has_letter(text):
        return UNDETERMINED, 0.0, []
    counts = trigrams(text)
    at = np.flatnonzero(counts)
    counts, logs = counts[at].astype(np.float64), model[:, at].astype(np.float64)
    likelihoods = np.exp(logs - logs.max(axis=0))
    every, _ = proportions(likelihoods, counts)
    order = np.argsort(-every, kind="stable")
    order = np.concatenate([[best := int((logs @ counts).argmax())], order[order != best]])
    price = PENALTY * math.log(counts.sum() + 1)
    share, reached = proportions(likelihoods[order[:1]], counts)
    k = 1
    while k < len(langs):
        wider, more = proportions(likelihoods[order[: k + 1]], counts)
        if more - reached <= price:
            break
        share, reached, k = wider, more, k + 1
    top = int(order[int(share.argmax())])
    return langs[top], float(min(1.0, max(0.0, every[top]))), [langs[i] for i in order[:k]]


def predict(docs: DataFrame, langs: list[str], model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``lang_pred``, ``score`` and ``languages`` (the chosen set).

    Null texts, texts without a letter, and all texts if nothing was learned,
    are ``und`` with score 0.  Languages that tie go by their order as text.
    Rows may repeat; ids may be null; only the text is an input of the
    prediction.
    """
    shared = docs.sparkSession.sparkContext.broadcast((langs, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shared.value
        for b in batches:
            found = [predict_one(t.as_py(), names, table) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.list_(pa.string()))], schema.names)

    schema = docs.select(id_col).schema.add("lang_pred", "string").add("score", "double").add("languages", T.ArrayType(T.StringType()))
    return docs.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, schema)
