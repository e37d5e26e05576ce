"""Running order statistics, selection, sweeps, prefix sums and ring sums against plain code, and on two million rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowlens.functions import rolling, selection
from flowlens.operators import index as I
from flowlens.operators import resample as B
from flowlens.operators import streaks as S

N = 2_000_000


def noise(n, seed=0):
    return np.random.default_rng(seed).standard_normal(n)


@pytest.fixture()
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# ---------------------------------------------------------------- frames


def test_frames_equal_numpy_over_batches(spark, small_batches):
    rows = [(g, t, None if (t * 7 + i) % 5 == 0 else float((t * (i + 3)) % 11)) for i, g in enumerate(["a", None, "c"]) for t in range(60) if t % 4]
    df = spark.createDataFrame(rows, "g string, t int, v double").repartition(3)
    by_row = rolling.trailing(df.filter("v is not null"), ["g"], "v", 6, {"q": 0.3}, "n", "le", current=False).collect()
    by_day = rolling.trailing(df, ["g"], "v", 6, {"q": 0.3}, "n", "le", by_sessions=True).collect()
    assert len(by_day) == len(rows)
    for got, days in ((by_row, False), (by_day, True)):
        for r in got:
            own = sorted((t, v) for g, t, v in rows if g == r["g"] and v is not None)
            frame = [v for t, v in own if r["t"] - 6 < t <= r["t"]] if days else [v for t, v in own if t < r["t"]][-6:]
            assert r["n"] == len(frame) and r["le"] == (None if r["v"] is None else sum(x <= r["v"] for x in frame))
            assert r["q"] == (pytest.approx(np.quantile(frame, 0.3)) if frame else None)


def test_frame_without_keys_and_odd_values(spark):
    df = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, None), (3, 3.0)], "t int, v double")
    got = rolling.trailing(df, [], "v", 2, {"m": 0.5}, "n").orderBy("t").collect()
    assert [(r["m"], r["n"]) for r in got] == [(1.0, 1), (1.0, 1), (1.0, 1), (2.0, 2)]
    assert rolling.trailing(df.limit(0), [], "v", 2, {"m": 0.5}, "n").count() == 0


def test_frames_of_two_million_rows(spark):
    df = spark.range(N).select((F.col("id") % 40).alias("g"), F.floor(F.col("id") / 40).cast("int").alias("t"), F.pmod(F.xxhash64("id"), F.lit(10_007)).cast("double").alias("v"))
    got = rolling.trailing(df, ["g"], "v", 252, {"hi": 0.8, "lo": 0.2}, "n", "le")
    assert got.count() == N
    own = got.filter("g = 17").orderBy("t").toPandas()
    v = own["v"].to_numpy()
    for i in (0, 1, 250, 251, 252, 31_000, len(v) - 1):
        frame = v[max(0, i - 251) : i + 1]
        assert [own["hi"][i], own["lo"][i], own["n"][i], own["le"][i]] == [pytest.approx(np.quantile(frame, 0.8)), pytest.approx(np.quantile(frame, 0.2)), len(frame), (frame <= v[i]).sum()]


# ---------------------------------------------------------------- selection


def test_selected_ranks_of_odd_groups(spark):
    groups = {"one": [5.0], "ties": [2.0] * 50 + [3.0], "wide": [-1e300, -1.0, 0.0, 1e-300, 1e300], "long": list(noise(9000)), None: [1.0, 2.0], "none": [None, float("nan")]}
    rows = [(g, v) for g, own in groups.items() for v in own]
    df = spark.createDataFrame([(g, None if v is None else float(v)) for g, v in rows], "g string, v double").repartition(5)
    got = {r["g"]: r for r in selection.picked(df, ["g"], "v", {"median": selection.linear(0.5), "third": lambda n: F.floor(n * 3 / 10)}).collect()}
    assert set(got) == set(groups) - {"none"}
    for g, r in got.items():
        own = np.sort(groups[g])
        assert r["n"] == len(own) and r["median"] == pytest.approx(np.quantile(own, 0.5), rel=1e-15) and r["third"] == own[len(own) * 3 // 10]
    assert selection.picked(df.limit(0), [], "v", {"m": selection.linear(0.5)}).count() == 0


def test_selected_ranks_of_two_million_rows(spark):
    x = F.pmod(F.col("id") * 1_000_003, F.lit(N))
    df = spark.range(N).select((F.col("id") % 3 > 0).alias("g"), F.exp(x / 50_000).alias("v"))  # a group has two thirds; values are far from even
    got = selection.picked(df.withColumn("h", F.lit("x")), ["h"], "v", {"m": selection.linear(0.5), "p": lambda n: F.floor((n - 1) * 0.01)}).first()
    assert (got["n"], got["m"], got["p"]) == (N, pytest.approx((np.exp((N // 2 - 1) / 50_000) + np.exp(N // 2 / 50_000)) / 2, rel=1e-14), pytest.approx(np.exp((N - 1) // 100 / 50_000), rel=1e-14))
    own = {r["g"]: (r["n"], r["m"]) for r in selection.picked(df, ["g"], "v", {"m": selection.linear(0.5)}).collect()}
    every = df.toPandas()
    for g in (True, False):
        mine = every["v"][every["g"] == g]
        assert own[g] == (len(mine), pytest.approx(mine.median(), rel=1e-14))


# ---------------------------------------------------------------- the sweep


def exploded(states, run):
    """Band events the long way: each row to each band that holds it, islands in each."""
    bands = [(lo, hi) for lo in range(1, 11) for hi in range(lo, 11)]
    out = set()
    for s, own in states.groupby("symbol"):
        for lo, hi in bands:
            k, before = 0, None
            for t, d in sorted(zip(own["t"], own["decile"])):
                inside = d == d and lo <= d <= hi
                k = (k + 1 if before == t - 1 else 1) if inside else 0
                before = t
                if k == run:
                    out.add((s, t, lo, hi))
    return out


@pytest.mark.parametrize("run", [1, 3, 5])
def test_band_events_equal_islands(spark, run):
    walk = np.random.default_rng(run)
    rows = []
    for s in "abc":
        d = 5
        for t in range(400):
            d = int(np.clip(d + walk.integers(-1, 2), 1, 10))
            if walk.random() > 0.08:
                rows.append((s, t, None if walk.random() < 0.05 else d))
    states = spark.createDataFrame(rows, "symbol string, t int, decile int")
    got = {(r["symbol"], r["t"], b["lo"], b["hi"]) for r in S.band_events(states, run).collect() for b in r["bands"]}
    assert got == exploded(pd.DataFrame(rows, columns=["symbol", "t", "decile"]), run) and len(got) > 50


def test_sweep_of_two_million_states(spark):
    """Deciles in blocks of eight sessions: band lo-hi has an event per block run inside it, which can be counted."""
    block = F.floor(F.col("id") / 8)
    states = spark.range(N).select(F.format_string("s%02d", F.floor(F.col("id") / 50_000)).alias("symbol"), (F.col("id") % 50_000).cast("int").alias("t"), (F.pmod(block, F.lit(10)) + 1).cast("int").alias("decile"))
    events = S.band_events(states, 5).select(F.explode("bands").alias("b")).groupBy("b.lo", "b.hi").count().collect()
    got = {(r["lo"], r["hi"]): r["count"] for r in events}
    blocks, names = 50_000 // 8, N // 50_000
    assert got[1, 10] == names and len(got) == 55
    assert all(got[lo, hi] == names * (blocks // 10) for lo in range(1, 11) for hi in range(lo, 11) if (lo, hi) != (1, 10))
    returns = states.select("symbol", "t", F.lit(21).alias("h"), (F.col("t") % 100).cast("double").alias("ret"))
    one = S.band_sweep(states, returns, 5).filter("lo = 3 and hi = 3").first()
    own = [t % 100 for b in range(blocks) if b % 10 == 2 for t in [8 * b + 4]] * names
    mid = np.median(own)
    assert (one["n"], one["mean"], one["median"], one["mad"]) == (len(own), pytest.approx(np.mean(own)), mid, np.median(np.abs(np.array(own) - mid)))


def test_sweep_table_keeps_bands_without_returns(spark):
    states = spark.createDataFrame([("a", t, 1) for t in range(6)], "symbol string, t int, decile int")
    returns = spark.createDataFrame([("a", 2, 21, 0.5)], "symbol string, t int, h int, ret double")
    got = {(r["lo"], r["hi"], r["h"]): (r["streaks"], r["n"], r["mean"]) for r in S.sweep_table(states, returns, 3).collect()}
    assert got[1, 1, 21] == (1, 1, 0.5) and got[1, 10, 42] == (1, 0, None) and got[0, 0, 21] == (None, 1, 0.5) and len(got) == 31


# ---------------------------------------------------------------- sums that are carried on


def test_running_sums_keep_their_digits(spark):
    """20,000 sessions of values near 1e4 with deviations near 1, where plain running sums of squares would lose eight digits."""
    n = 20_000
    b = 1e4 + noise(n, 1).cumsum() / 50
    x = 1e4 + 0.7 * (b - 1e4) + noise(n, 2)
    x[noise(n, 3) > 1] = np.nan
    own = spark.createDataFrame(pd.DataFrame({"symbol": "a", "t": np.arange(n, dtype="int32"), "dd": x})).withColumn("dd", F.when(~F.isnan("dd"), F.col("dd")))
    bench = spark.createDataFrame(pd.DataFrame({"t": np.arange(n, dtype="int32"), "b": b}))
    got = I.residuals(own, bench).orderBy("t").toPandas()
    for i in (10, 60, 125, 126, 5_000, 19_999):
        w = slice(max(0, i - 125), i + 1)
        xs, bs = x[w], b[w]
        ok = ~np.isnan(xs)
        if ok.sum() < 40 or np.isnan(x[i]):
            assert pd.isna(got["reg"][i])
            continue
        beta = np.cov(xs[ok], bs[ok])[0, 1] / bs.var(ddof=1)
        assert got["beta"][i] == pytest.approx(beta, rel=1e-7)
        assert got["reg"][i] == pytest.approx(x[i] - (np.nanmean(xs) - beta * bs.mean() + beta * b[i]), abs=1e-7)


def test_residual_of_a_flat_benchmark(spark):
    own = spark.createDataFrame([("a", t, 0.1 * (t % 3)) for t in range(60)], "symbol string, t int, dd double")
    got = I.residuals(own, spark.createDataFrame([(t, 0.3) for t in range(60)], "t int, b double"), least=5)
    assert got.filter("reg is not null").count() == 0 and got.filter("diff is not null").count() == 60


def test_ring_sums_equal_shifts(spark):
    ret, hit = noise(37), (noise(37, 5) > 0.8).astype(int)
    got = B.ring_sums(pd.DataFrame({"symbol": "a", "pos": range(37), "ret": ret, "hit": hit}))
    want = [sum(ret[(p + k) % 37] for p in np.flatnonzero(hit)) for k in range(37)]
    assert got["events"][0] == hit.sum() and np.allclose(got["sums"][0], want, atol=1e-12)


def test_placebo_of_few_names(spark):
    returns = spark.createDataFrame([("a", t, float(t)) for t in range(8)] + [("b", t, 1.0) for t in range(5)], "symbol string, t int, ret double")
    events = spark.createDataFrame([("a", 7), ("b", 1), ("b", 4), ("b", 9), ("c", 1)], "symbol string, t int")
    got = B.permutation_test(events, returns).first()
    assert got["n"] == 3 and got["mean"] == pytest.approx(3.0) and 1 < got["placebo"] < 3.0
    assert got["p"] == pytest.approx(1 / 4, abs=0.08) and 0.8 < got["percentile"] < 0.95  # of 8 offsets, 0 and 7 away are as far
    assert B.permutation_test(events.filter("t = 9"), returns).count() == 0


def test_residuals_of_two_million_rows(spark):
    names, n = 100, N // 100
    own = spark.range(N).select(F.format_string("s%02d", F.floor(F.col("id") / n)).alias("symbol"), (F.col("id") % n).cast("int").alias("t"), ((F.xxhash64("id") % 1000) / 1000.0).alias("dd"))
    bench = spark.range(n).select(F.col("id").cast("int").alias("t"), (F.sin(F.col("id") / 40) + (F.xxhash64(F.col("id") + 7) % 1000) / 5000.0).alias("b"))
    got = I.residuals(own, bench)
    assert got.filter("reg is not null").count() == names * (n - 39)
    mine = got.filter("symbol = 's41'").orderBy("t").toPandas()
    for i in (39, 126, 9_999, n - 1):
        x, b = (mine[c].to_numpy()[max(0, i - 125) : i + 1] for c in ("dd", "b"))
        beta = np.cov(x, b)[0, 1] / b.var(ddof=1)
        assert mine["reg"][i] == pytest.approx(x[-1] - (x.mean() - beta * b.mean() + beta * b[-1]), abs=1e-9)


def test_placebo_over_two_million_returns(spark):
    n = N // 40
    returns = spark.range(N).select(F.format_string("s%02d", F.floor(F.col("id") / n)).alias("symbol"), (F.col("id") % n).cast("int").alias("t"), ((F.xxhash64("id") % 1000) / 1e5).alias("ret"))
    events = returns.filter("t % 50 = 7").select("symbol", "t")
    got = B.permutation_test(events, returns).first()
    assert got["n"] == N // 50 and got["mean"] == pytest.approx(returns.filter("t % 50 = 7").agg(F.avg("ret")).first()[0], abs=1e-12)
    assert abs(got["placebo"]) < 1e-4 and 0 < got["p"] <= 1 and 0 <= got["percentile"] <= 1
