"""Resampling with seeds that are hashes, so that reruns agree."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from flowlens.functions.store import cut
from flowlens.operators.relation import ranked


def drawn(seed: int, *keys: str) -> Column:
    """A number from 0 to 2**60 - 1 by md5, which SQL engines share."""
    return hashed(seed, *(F.col(k) for k in keys))


def hashed(seed: int, *keys: Column) -> Column:
    text = F.concat_ws("/", F.lit(str(seed)), *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def block_sums(numbered: DataFrame, block: int, chunk: int = 1 << 16) -> DataFrame:
    """Per place i: sums over the points i to i + block - 1, as far as there are any.

    Places are summed in chunks; a chunk also has the first ``block`` - 1 points of the next one.
    """
    at = F.floor(F.col("i") / chunk)
    chunks = F.when((F.col("i") % chunk < block - 1) & (at > 0), F.array(at - 1, at)).otherwise(F.array(at))
    dealt = numbered.withColumn("_own", at).withColumn("_chunk", F.explode(chunks))
    ahead = W.partitionBy("_chunk").orderBy("i").rowsBetween(0, block - 1)
    sums = {"n": F.lit(1), "x": F.col("x"), "y": F.col("y"), "xy": F.col("x") * F.col("y"), "xx": F.col("x") * F.col("x"), "yy": F.col("y") * F.col("y")}
    return dealt.select("i", "_own", "_chunk", *(F.sum(v).over(ahead).alias(k) for k, v in sums.items())).filter("_own = _chunk").drop("_own", "_chunk")


def block_bootstrap(pts: DataFrame, block: int, draws: int = 300, seed: int = 7, least: int = 30) -> DataFrame:
    """95 % interval of the pooled correlation by a moving-block bootstrap: one row (n, draws, lo, hi).

    Points lie in order of (symbol, t). Blocks of ``block`` points start at
    hashed places; each of ``draws`` draws has ceil(n / block) blocks, added up
    from the sums of every possible block. Null under 3 blocks of points or
    ``least`` valid draws.
    """
    numbered = ranked(pts, ["symbol", "t"], "i").select("i", "x", "y").withColumn("i", F.col("i").cast("long"))
    n = numbered.count()
    per = -(-n // block) if n >= 3 * block else 0
    cells = numbered.sparkSession.range(draws * per).select(F.floor(F.col("id") / max(per, 1)).alias("b"), "id")
    starts = cells.select("b", F.pmod(drawn(seed, "id"), F.lit(max(1, n - block + 1))).alias("i"))
    center = numbered.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))  # about the means, sums of squares keep their digits
    shifted = numbered.join(F.broadcast(center)).select("i", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"))
    s = starts.join(block_sums(shifted, block), "i").groupBy("b").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y", "xy", "xx", "yy")))
    var = lambda c: F.col(c + c) - F.col(c) * F.col(c) / F.col("n")
    r = s.select("b", ((F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.sqrt(var("x") * var("y"))).alias("r")).filter("r is not null and not isnan(r)")
    placed = r.withColumn("k", F.row_number().over(W.orderBy("r")) - 1).withColumn("m", F.count("*").over(W.partitionBy()))  # a row a draw
    at = lambda q: F.max(F.when(F.col("k") == F.least(F.col("m") - 1, F.floor(q * F.col("m"))), F.col("r")))
    out = placed.agg(F.count("*").alias("draws"), at(0.025).alias("lo"), at(0.975).alias("hi"))
    good = F.col("draws") >= least
    return out.select(F.lit(n).cast("long").alias("n"), "draws", F.when(good, F.col("lo")).alias("lo"), F.when(good, F.col("hi")).alias("hi"))


def ring_sums(ring: pd.DataFrame) -> pd.DataFrame:
    """One name's ring (symbol, pos, ret, hit): the sum of the returns at its events moved by each offset, all offsets at once.

    The circular cross-correlation of the train of events with the ring of returns.
    """
    ring = ring.sort_values("pos")
    hit, ret = ring["hit"].to_numpy(float), ring["ret"].to_numpy(float)
    sums = np.fft.irfft(np.conj(np.fft.rfft(hit)) * np.fft.rfft(ret - ret.mean()), len(ring)) + hit.sum() * ret.mean()
    return pd.DataFrame({"symbol": [ring["symbol"].iloc[0]], "events": [int(hit.sum())], "sums": [sums]})


def permutation_test(events: DataFrame, returns: DataFrame, draws: int = 500, seed: int = 11, least: int = 3, near: float = 1e-12) -> DataFrame:
    """Two-sided p of the events' mean return against circular shifts: one row (n, mean, placebo, p, percentile).

    In each draw every name's events move by one hashed offset on the ring of
    its sessions that have a return; a draw looks its sum up among those of all
    offsets, so events are not copied to draws. Deviations that differ by less than ``near`` count as equal.
    ``returns``: (symbol, t, ret), a name's ring fits a task: a row a session.
    """
    ring = returns.withColumn("pos", F.row_number().over(W.partitionBy("symbol").orderBy("t")) - 1)
    ring = ring.join(events.select("symbol", "t").distinct().withColumn("hit", F.lit(1)), ["symbol", "t"], "left").select("symbol", "pos", "ret", F.coalesce("hit", F.lit(0)).alias("hit"))
    ring = ring.withColumn("_n", F.sum("hit").over(W.partitionBy("symbol"))).filter("_n > 0").drop("_n")
    sums = ring.groupBy("symbol").applyInPandas(ring_sums, "symbol string, events long, sums array<double>")
    shift = lambda draw: F.pmod(hashed(seed, F.col("symbol"), draw), F.size("sums")).cast("int")
    looked = sums.select("events", F.get("sums", 0).alias("real"), F.transform(F.sequence(F.lit(1), F.lit(draws)), lambda d: F.get("sums", shift(d))).alias("m"))
    looked = cut(looked)  # a row a name
    real = looked.agg(F.sum("events").alias("n"), (F.sum("real") / F.sum("events")).alias("mean"))
    means = looked.select("events", F.posexplode("m").alias("draw", "s")).groupBy("draw").agg((F.sum("s") / F.sum("events")).alias("m"))
    both = means.join(F.broadcast(real))  # one row
    center = F.avg("m").over(W.partitionBy())
    both = both.withColumn("center", center).withColumn("far", F.abs(F.col("m") - F.col("center")) >= F.abs(F.col("mean") - F.col("center")) - near)
    out = both.groupBy("n", "mean", "center").agg(F.count_if("far").alias("ge"), F.count("*").alias("b"), F.avg((F.col("m") < F.col("mean") - near).cast("double")).alias("percentile"))
    return out.filter(F.col("n") >= least).select("n", "mean", F.col("center").alias("placebo"), ((F.col("ge") + 1) / (F.col("b") + 1)).alias("p"), "percentile")
