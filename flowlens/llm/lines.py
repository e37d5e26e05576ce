"""Quality of documents from their lines: a linear-chain conditional random field calls each line good or bad.

A line's features are shares and logarithms of what its characters and words
are, its place, and the same of the lines before and after it.  The field is
learned from a bounded sample of labelled documents, of which only whole
documents are labelled: lines of good documents are good; of bad documents those
are bad that the field itself calls bad, at least the worst one, and the field is
learned again with them.  Marginals by forward and backward recursion, weighted
by the lines' lengths, are averaged, and a logistic curve over the averages,
fitted to documents that the field has not seen, gives the document's score.

Texts are taken apart as arrays of code points, all lines of some documents at once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents the field and the curve are learned from, at most; those with the lowest hash of the id.
SAMPLE = 4000
#: Texts of more characters or lines are not sampled. Scores look at whole texts of any length.
REACH, LINES = 20_000, 200
#: Characters worked on at a time, but for texts that are longer by themselves.
CHUNK = 1 << 20

SPACE, LOWER, UPPER, LETTER, DIGIT, POINT, SYMBOL = range(7)
#: Characters that end or divide sentences.
POINTS = ".,;:'\"-()?…’“”«»¿¡–—"
NAMES = ("length", "words", "upper", "digits", "points", "symbols", "marked", "loud", "short", "again", "distinct", "seen", "word_length", "ended", "first", "last")


# ---------------------------------------------------------------- features


@cache
def kinds() -> np.ndarray:
    """Kind of each code point; made once in a worker."""
    out = np.full(0x110000, SYMBOL, dtype=np.uint8)
    for c in range(0x110000):
        category = unicodedata.category(chr(c))
        if category[0] == "L" or category[0] == "M":
            out[c] = UPPER if category in ("Lu", "Lt") else LOWER if category == "Ll" else LETTER
        elif category[0] == "N":
            out[c] = DIGIT
        elif category[0] in "ZC":
            out[c] = SPACE
    out[[ord(c) for c in POINTS]] = POINT
    return out


@cache
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2 ** 64 and of its inverse."""
    base, inverse = 6364136223846793005, pow(6364136223846793005, -1, 1 << 64)
    return np.cumprod(np.full(n, base, dtype=np.uint64)), np.cumprod(np.full(n, inverse, dtype=np.uint64))


def digests(points: np.ndarray, starts: list[np.ndarray], ends: list[np.ndarray]) -> list[np.ndarray]:
    """A number for each span of code points; equal spans have equal ones, wherever they lie."""
    n = len(points)
    up, down = powers(CHUNK + 1) if n <= CHUNK else powers.__wrapped__(n + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
    out = []
    for a, b in zip(starts, ends):
        mixed = (total[b] - total[a]) * down[a]
        mixed ^= mixed >> np.uint64(29)
        out.append(mixed * np.uint64(0x9E3779B97F4A7C15))
    return out


def blocks(texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """Pieces of texts that end at line ends, and their texts' places, in blocks of up to ``CHUNK`` characters; a longer line is a block."""
    pieces, places, size = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while at <= len(text):
            end = len(text)
            if end - at > CHUNK:
                end = text.rfind("\n", at, at + CHUNK)
                end = text.find("\n", at + CHUNK) if end < 0 else end
                end = len(text) if end < 0 else end
            if size and size + end - at > CHUNK:
                yield pieces, places
                pieces, places, size = [], [], 0
            pieces.append(text[at:end])
            places.append(i)
            size += end - at + 1
            at = end + 1
    if pieces:
        yield pieces, places


def block_features(pieces: list[str], places: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, length, text's place, digest) of each line of a block; what needs the whole text is left at 0."""
    points = np.frombuffer("\n".join(pieces).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = kinds()[points]
    ends = np.append(np.flatnonzero(points == 10), len(points))
    starts = np.append(0, ends[:-1] + 1)
    doc = np.repeat(places, [p.count("\n") + 1 for p in pieces])
    n, size = len(starts), ends - starts

    def up_to(flags: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])

    blank = kind == SPACE
    begin = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]])) if len(points) else np.zeros(0, int)
    finish = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1 if len(points) else np.zeros(0, int)
    line = np.searchsorted(starts, begin, "right") - 1
    word, own = digests(points, [begin, starts], [finish, ends])
    solid, letters, capitals, cases, digits, stops, marks = (up_to(f) for f in (~blank, (kind >= LOWER) & (kind <= LETTER), kind == UPPER, (kind == UPPER) | (kind == LOWER), kind == DIGIT, kind == POINT, kind == SYMBOL))
    has, caps, marked = letters[finish] - letters[begin], capitals[finish] - capitals[begin], marks[finish] > marks[begin]
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((word, line))
    fresh = np.ones(len(word))
    fresh[order[1:]] = (word[order][1:] != word[order][:-1]) | (line[order][1:] != line[order][:-1])

    per_line = lambda total: (total[ends] - total[starts]).astype(float)
    in_line = lambda flags: np.bincount(line, weights=flags, minlength=n)
    share = lambda part, whole: part / np.maximum(whole, 1)
    words, filled = np.bincount(line, minlength=n).astype(float), per_line(solid)
    ended = np.where(filled > 0, stops[ends] > stops[np.maximum(ends - 1, starts)], False)
    nothing = np.zeros(n)
    table = {
        "length": np.log1p(size) / 5, "words": np.log1p(words) / 4, "upper": share(per_line(capitals), per_line(cases)), "digits": share(per_line(digits), filled), "points": share(per_line(stops), filled),
        "symbols": np.minimum(1, 5 * share(per_line(marks), filled)), "marked": share(in_line(marked), words), "loud": share(in_line((caps == has) & (has > 1)), words), "short": share(in_line(has < 3), words),
        "again": share(in_line(again), words), "distinct": share(in_line(fresh), words), "seen": nothing, "word_length": np.minimum(2, share(filled, words) / 10), "ended": ended, "first": nothing, "last": nothing,
    }
    return np.stack([table[k] for k in NAMES], 1).astype(float), np.where(filled > 0, size, 0).astype(float), doc, own


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, length, text's place) of every line of the texts, in order; a text has a line more than line ends."""
    parts = [block_features(*b) for b in blocks(texts)]
    x, size, doc, own = (np.concatenate([p[k] for p in parts]) for k in range(4))
    order = np.lexsort((np.arange(len(own)), own, doc))
    seen = np.zeros(len(own))
    seen[order[1:]] = (own[order][1:] == own[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    edge = np.concatenate([[True], doc[1:] != doc[:-1], [True]])
    x[:, NAMES.index("seen")] = seen * (size > 0)
    x[:, NAMES.index("first")], x[:, NAMES.index("last")] = edge[:-1], edge[1:]
    return x, size, doc


def with_neighbours(own: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A line's features, those of the line before and after it in its document (zeros at the ends), and a constant."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = (doc[1:] == doc[:-1])[:, None]
    before[1:], after[:-1] = own[:-1] * same, own[1:] * same
    return np.concatenate([own, before, after, np.ones((len(own), 1))], 1)


# ---------------------------------------------------------------- the field


def spans_of(doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First line of each of n documents, each of which has one, and its number of lines."""
    count = np.bincount(doc, minlength=n)
    return np.cumsum(count) - count, count


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def marginals(x: np.ndarray, theta: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward: log-odds of each line being good, and expected links (2, 2), summed over neighbouring lines.

    ``theta``: the features' weights for good lines, then the links from a line to the next, bad or
    good. Documents go side by side, longest first, a line of each a step.
    """
    links = theta[-4:].reshape(2, 2)
    unary = np.zeros((len(x), 2))
    unary[:, 1] = x @ theta[:-4]
    forward, backward = unary.copy(), np.zeros_like(unary)
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    alive = np.searchsorted(-count, -np.arange(count.max(initial=0)), "left")  # how many documents have a line t
    for t in range(1, len(alive)):
        at = first[: alive[t]] + t
        before = forward[at - 1][:, :, None] + links
        forward[at] = unary[at] + np.logaddexp(before[:, 0], before[:, 1])
    ends = first + count - 1
    log_z = np.logaddexp(forward[ends, 0], forward[ends, 1])
    expected = np.zeros((2, 2))
    for t in range(len(alive) - 1, 0, -1):
        at = first[: alive[t]] + t
        after = (unary[at] + backward[at])[:, None, :] + links
        backward[at - 1] = np.logaddexp(after[:, :, 0], after[:, :, 1])
        expected += np.exp(forward[at - 1][:, :, None] + after - log_z[: alive[t], None, None]).sum(0)
    both = forward + backward
    return both[:, 1] - both[:, 0], expected


def fit_field(x: np.ndarray, y: np.ndarray, doc: np.ndarray, n: int, start: np.ndarray | None = None, linked: bool = True, steps: int = 120, ridge: float = 1e-4) -> np.ndarray:
    """Weights of the features for good lines (for bad ones they are 0) and, last, the four links, by Adam on the likelihood of the lines' labels ``y``."""
    first, count = spans_of(doc, n)
    theta = np.zeros(x.shape[1] + 4) if start is None else start.copy()
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    inside = np.ones(len(doc), bool)
    inside[first] = False
    pairs = np.zeros((2, 2))
    at = np.flatnonzero(inside)
    np.add.at(pairs, (y[at - 1], y[at]), 1)
    for step in range(1, steps + 1):
        odds, expected = marginals(x, theta, first, count)
        gradient = np.concatenate([x.T @ (y - sigmoid(odds)), (pairs - expected).ravel() * linked]) / len(x) - ridge * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient * gradient
        theta = theta + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return theta


def averages(good: np.ndarray, size: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Mean of each document's marginals, weighted by the lines' lengths; of a document without characters, by their number."""
    heavy = size + 1e-6
    return np.bincount(doc, weights=good * heavy, minlength=n) / np.bincount(doc, weights=heavy, minlength=n)


def fit_curve(mean: np.ndarray, y: np.ndarray, steps: int = 40) -> tuple[float, float]:
    """Slope and offset of a logistic curve over the log-odds of the averages, by Newton's method with a small ridge."""
    z = np.stack([log_odds(mean), np.ones(len(mean))], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(z @ beta)
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(h, z.T @ (y - p) - 1e-2 * (beta - [1.0, 0.0])), -2, 2)
    return float(max(beta[0], 1e-3)), float(beta[1])


def learn_from(texts: list[str], quality: list[int]) -> dict:
    """The model: the field's weights and the curve. With one class only, its share of good ones is every score."""
    if len(set(quality)) < 2:
        return {"theta": None, "constant": (sum(quality) + 1) / (len(quality) + 2)}
    good = np.array(quality) == 1
    held = np.zeros(len(texts), bool)
    for c in (True, False):  # every third of either class is kept for the curve
        held[np.flatnonzero(good == c)[2::3]] = True
    own, size, doc = line_features(texts)
    x = with_neighbours(own, doc)
    used = ~held[doc]
    xs, ds = x[used], np.cumsum(~held)[doc[used]] - 1
    n, truth = int((~held).sum()), good[~held]
    first, count = spans_of(ds, n)
    labels = truth[ds].astype(int)
    theta = fit_field(xs, labels, ds, n, linked=False)
    for linked in (False, True):
        odds, _ = marginals(xs, theta, first, count)
        worst = np.minimum.reduceat(odds, first)
        labels = np.where(truth[ds] | ((odds > 0) & (odds > worst[ds])), 1, 0)
        theta = fit_field(xs, labels, ds, n, theta, linked)
    every, counts = spans_of(doc, len(texts))
    mean = averages(sigmoid(marginals(x, theta, every, counts)[0]), size, doc, len(texts))
    a, b = fit_curve(mean[held], good[held].astype(float))
    return {"theta": theta, "a": a, "b": b}


def judge(texts: list[str], model: dict) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each text's score, and its lines' probabilities of being good."""
    if model["theta"] is None:
        return np.full(len(texts), model["constant"]), [np.full(t.count("\n") + 1, model["constant"]) for t in texts]
    own, size, doc = line_features(texts)
    first, count = spans_of(doc, len(texts))
    good = sigmoid(marginals(with_neighbours(own, doc), model["theta"], first, count)[0])
    score = sigmoid(model["a"] * log_odds(averages(good, size, doc, len(texts))) + model["b"])
    return score, np.split(good, first[1:])


# ---------------------------------------------------------------- over rows


def in_lots(texts: list[str]) -> Iterator[list[str]]:
    """Runs of whole texts of up to ``CHUNK`` characters; a longer text is a run."""
    lot, size = [], 0
    for text in texts:
        if lot and size + len(text) > CHUNK:
            yield lot
            lot, size = [], 0
        lot.append(text)
        size += len(text) + 1
    if lot:
        yield lot


def held_out(id: str = "doc_id") -> Column:
    """Rows whose labels are not learned from: crc32 of the id as text, modulo 3, is 1. False for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The model from at most ``sample`` labelled documents that are not held out, those of the lowest hashes of id and text.

    Ids labelled 0 as well as 1, and null ids, texts and labels, teach nothing; nor do texts of more
    than ``REACH`` characters or ``LINES`` lines, which bounds what the driver holds.
    """
    votes = labels.filter("doc_id is not null and quality in (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("_q"), F.max("quality").alias("_r")).filter("_q = _r")
    votes = votes.select(F.col("doc_id").alias("_id"), "_q").orderBy(F.xxhash64("_id"), "_id").limit(sample)
    own = docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text")).filter(F.col("_text").isNotNull() & (F.length("_text") <= REACH))
    own = own.join(F.broadcast(votes), F.col("_doc") == F.col("_id")).filter(F.size(F.split("_text", "\n")) <= LINES)  # of a bounded number of ids
    rows = own.orderBy(F.xxhash64("_id"), F.xxhash64("_text"), "_id").limit(sample).select("_text", "_q").collect()
    return learn_from([r["_text"] for r in rows], [r["_q"] for r in rows])


def score(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Adds ``judged``: a struct of the document's score and its lines' probabilities, in order.

    A null text counts as empty; an empty text is one empty line. Repeated texts
    have equal scores. A task holds one batch of texts and, beside it, the arrays of
    one lot of ``CHUNK`` characters, or of the longest text's lines, which are worked
    on in blocks of that size; only a line beyond it is one block, of about 80 bytes a
    character. Further columns stay; one named ``judged`` is replaced.
    """

    @F.pandas_udf("score double, good array<double>")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            scores, lines = [], []
            for lot in in_lots(batch.fillna("").tolist()):
                own, good = judge(lot, model)
                scores.extend(own.tolist())
                lines.extend(good)
            yield pd.DataFrame({"score": pd.Series(scores, dtype=float), "good": pd.Series(lines, dtype=object)})

    return docs.withColumn("judged", judged(F.col(f"`{text}`")))
