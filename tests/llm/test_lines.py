"""Line features, the field's recursions and gradient, held-out accuracy, odd rows."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import lines, queries

TEXTS = ["One line, with 3 words.\nOne line, with 3 words.\n\nLOUD LINE!! AND $$$ SIGNS\na a a b", "", "\n", "x", "é漢 ß🙂 Ǆ\tÄÖ\x0b\x85   z", " | ".join(["cell"] * 30), "The end"]


def plain_features(text):
    kind = lambda c: int(lines.kinds()[ord(c)])
    out, before = [], set()
    parts = text.split("\n")
    for i, line in enumerate(parts):
        words, word = [], ""
        for c in line + " ":
            if kind(c) == lines.SPACE:
                words, word = (words + [word] if word else words), ""
            else:
                word += c
        solid = [c for c in line if kind(c) != lines.SPACE]
        n = lambda *ks: sum(kind(c) in ks for c in line)
        share = lambda a, b: a / max(b, 1)
        letters = [[c for c in w if kind(c) in (lines.LOWER, lines.UPPER, lines.LETTER)] for w in words]
        loud = sum(len(x) > 1 and all(kind(c) == lines.UPPER for c in x) for x in letters)
        out.append([
            np.log1p(len(line)) / 5, np.log1p(len(words)) / 4, share(n(lines.UPPER), n(lines.UPPER, lines.LOWER)), share(n(lines.DIGIT), len(solid)), share(n(lines.POINT), len(solid)),
            min(1, 5 * share(n(lines.SYMBOL), len(solid))), share(sum(any(kind(c) == lines.SYMBOL for c in w) for w in words), len(words)), share(loud, len(words)), share(sum(len(x) < 3 for x in letters), len(words)),
            share(sum(a == b for a, b in zip(words, words[1:])), len(words)), share(len(set(words)), len(words)), float(bool(solid) and line in before), min(2, share(len(solid), len(words)) / 10),
            float(bool(solid) and kind(line[-1]) == lines.POINT), float(i == 0), float(i == len(parts) - 1),
        ])
        before.add(line)
    return np.array(out)


@pytest.mark.parametrize("chunk", [1 << 20, 40, 7])
def test_features_equal_plain_code_in_blocks_of_any_size(monkeypatch, chunk):
    monkeypatch.setattr(lines, "CHUNK", chunk)
    x, size, doc = lines.line_features(TEXTS)
    assert np.allclose(x, np.concatenate([plain_features(t) for t in TEXTS]))
    assert doc.tolist() == [i for i, t in enumerate(TEXTS) for _ in t.split("\n")]
    near = lines.with_neighbours(x, doc)
    assert near.shape == (len(x), 3 * len(lines.NAMES) + 1) and not near[0, 16:32].any() and np.allclose(near[1, 16:32], x[0])


def field(seed=0, counts=(1, 4, 3, 2)):
    r = np.random.default_rng(seed)
    count = np.array(counts)
    return r.standard_normal((count.sum(), 5)), r.standard_normal(9), np.cumsum(count) - count, count


def every_labelling(x, theta, a, n):
    """(labels, log score) of each labelling of n lines from a on."""
    links = theta[-4:].reshape(2, 2)
    for y in itertools.product((0, 1), repeat=n):
        yield y, sum(v * (x[a + i] @ theta[:-4]) for i, v in enumerate(y)) + sum(links[p, q] for p, q in zip(y, y[1:]))


def test_marginals_equal_enumeration():
    x, theta, first, count = field()
    odds, expected = lines.marginals(x, theta, first, count)
    want, pairs = [], np.zeros((2, 2))
    for a, n in zip(first, count):
        all_of = list(every_labelling(x, theta, a, n))
        z = sum(np.exp(s) for _, s in all_of)
        good = np.zeros(n)
        for y, s in all_of:
            good += np.array(y) * np.exp(s) / z
            for p, q in zip(y, y[1:]):
                pairs[p, q] += np.exp(s) / z
        want += good.tolist()
    assert np.allclose(1 / (1 + np.exp(-odds)), want) and np.allclose(expected, pairs)


def test_fitting_raises_the_likelihood():
    x, theta, first, count = field(3, (4,) * 30)
    y = (x @ theta[:-4] + 0.3 * np.random.default_rng(1).standard_normal(len(x)) > 0).astype(int)
    doc = np.repeat(np.arange(len(count)), count)
    likelihood = lambda th: sum(next(s for l, s in every_labelling(x, th, a, n) if list(l) == y[a : a + n].tolist()) - np.log(sum(np.exp(s) for _, s in every_labelling(x, th, a, n))) for a, n in zip(first, count))  # noqa: E731, E741
    steps = [likelihood(lines.fit_field(x, y, doc, len(count), steps=k)) for k in (1, 10, 60)]
    assert steps[0] < steps[1] < steps[2] < -1e-3


def test_bad_lines_are_told_from_good_ones():
    good = "The quick brown fox jumps over the lazy dog, and then it rests for a while."
    junk = "BUY NOW!! $$$ CLICK HERE!! $$$ FREE!! ### WIN!!"
    texts = [f"{good} {i}\n{good[i % 9:]}\n{good} again {i}" for i in range(60)] + [f"{good} {i}\n{junk} {i}\n{junk} so {i}\n{junk}" for i in range(60)]
    model = lines.learn_from(texts, [1] * 60 + [0] * 60)
    score, each = lines.judge([f"{good}\n{junk}\n{junk} !!\n{junk} ##", f"{good}\n{good} more"], model)
    assert score[0] < 0.2 < 0.8 < score[1] and max(each[0][1:]) < 0.5 and min(each[1]) > 0.5


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op13_quality_classifier(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == y for p, y in held) >= 0.97 * len(held) > 50
    assert sum(p == 0 for p, y in held if y == 0) >= 0.9 * sum(y == 0 for _, y in held)


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs = spark.createDataFrame([(i, f"text number {i} {'junk!! ' * (i % 2)}") for i in range(300)], "doc_id long, text string")
    labels = docs.select("doc_id", (1 - F.col("doc_id") % 2).cast("int").alias("quality"))
    turned = labels.withColumn("quality", F.when(lines.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (lines.learn(docs, x) for x in (labels, turned))
    assert np.array_equal(a["theta"], b["theta"]) and (a["a"], a["b"]) == (b["a"], b["b"])


def test_odd_rows_and_few_labels(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (6, None), (7, 3)], "doc_id long, quality int")
    model = lines.learn(odd, labels)
    assert model == {"theta": None, "constant": 0.5} == lines.learn(none, labels)
    got = lines.score(odd.withColumn("judged", F.lit("mine")), model)
    assert got.columns == [*odd.columns, "judged"] and got.filter("judged.score = 0.5").count() == 9 and got.filter("score = 0.5").count() == 9
    texts = [f"a good line {i}\nanother" for i in range(40)] + ["!! ## $$ " * 9] * 40
    model = lines.learn_from(texts, [1] * 40 + [0] * 40)
    rows = {r["doc_id"]: r for r in lines.score(odd, model).collect()}
    assert rows[2]["judged"] == rows[3]["judged"] and len(rows[3]["judged"]["good"]) == 1 and all(0 <= r["judged"]["score"] <= 1 for r in rows.values())
    assert lines.score(none, model).count() == 0
    one = spark.createDataFrame([(i, "yes") for i in range(9)], "doc_id long, text string")
    assert 0.5 < lines.learn(one, one.select("doc_id", F.lit(1).alias("quality")))["constant"] < 1
