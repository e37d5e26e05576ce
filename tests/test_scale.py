"""Ranks and what stands on them, on more rows than one range holds, with further columns and several partitions."""

from pyspark.sql import functions as F

from flowlens.operators import relation as R
from flowlens.operators import resample as B

N = 2_000_000


def pool(spark):
    """N points whose x is a permutation of 0..N-1, over 7 partitions."""
    x = F.pmod(F.col("id") * 1_000_003, F.lit(N))
    return spark.range(N).repartition(7).select(F.format_string("s%02d", F.col("id") % 40).alias("symbol"), F.floor(F.col("id") / 40).cast("int").alias("t"), x.cast("double").alias("x"), (x % 1000).cast("double").alias("y"), F.lit("more").alias("extra"))


def test_ranks_are_exact_and_in_order(spark):
    got = R.ranked(pool(spark), ["x", "symbol", "t"], parts=64)
    assert got.columns == ["symbol", "t", "x", "y", "extra", "n", "rank"]
    r = got.agg(F.count("*"), F.countDistinct("rank"), F.min("rank"), F.max("rank"), F.count_if(F.col("rank") == F.col("x")), F.min("n"), F.max("n")).first()
    assert tuple(r) == (N, N, 0, N - 1, N, N, N)


def test_pooled_buckets_are_equal(spark):
    rows = sorted(tuple(r) for r in R.deciles(pool(spark)).select("bucket", "n", "x_lo", "x_hi", "y_median").collect())
    assert rows == [(b + 1, N // 10, float(b * N // 10), float((b + 1) * N // 10 - 1), 499.5) for b in range(10)]


def test_sample_and_blocks(spark):
    assert R.sampled(pool(spark), ["symbol", "t"], 1000).count() == 1000
    few = spark.range(400).select(F.col("id").alias("i"), F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    got = {r["i"]: (r["n"], r["x"], r["xy"]) for r in B.block_sums(few, 21, 50).collect()}
    for i in range(400):
        own = range(i, min(i + 21, 400))
        assert got[i] == (len(own), float(sum(own)), float(sum(k * (k % 7) for k in own)))


def test_ranks_of_empty_and_null(spark):
    none = pool(spark).limit(0)
    assert R.ranked(none, ["x"]).count() == 0 and R.deciles(none).count() == 0
    got = R.ranked(spark.createDataFrame([(None, 1), (2.0, 2), (1.0, 3)], "x double, k int"), ["x"]).orderBy("rank").collect()
    assert [r["k"] for r in got] == [1, 3, 2]
