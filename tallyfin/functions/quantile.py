"""Exact interpolated quantiles of many keys at several levels, by digits of the values.

No key's values meet in one task and nothing is sorted but a few thousand values in the end.  Values
are counted by their leading digit (sign and a sixteenth of an octave), which never decreases as
the value grows; the digit that holds a wanted rank is cut into finer ones between its own
least and largest value, until few values are left in it or all are equal, and those few are
gathered.  Each pass is a partial aggregation on (key, digit).  Two passes are usual and each further one
divides a crowded digit by PARTS.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfin.session import checkpoint, small

#: Digits of a finer pass, and values of one digit that are gathered at most.
PARTS, GATHERED = 4096, 4096


def leading_digit(v: Column) -> Column:
    """A whole number that never decreases with v: NaN is above all, as Spark sorts it; both zeros are 0."""
    size = F.abs(v)
    octaves = F.floor(F.log2(size) * 16).cast("long") + 20_000
    digit = F.when(F.isnan(v), 200_000).when(size == 0, 0).when(size == float("inf"), F.signum(v) * 100_000).otherwise(F.signum(v) * octaves)
    return digit.cast("int")


def _finer(v: Column, low: Column, high: Column) -> Column:
    """Which of PARTS equal pieces of [low, high] holds v; subtraction and division keep the order under rounding."""
    return F.floor((v - low) / (high - low) * PARTS).cast("int")


def _same(left: Sequence[str], right: Sequence[str]) -> Column:
    on = F.lit(True)
    for a, b in zip(left, right):
        on = on & F.col(a).eqNullSafe(F.col(b))
    return on


def _cumulated(counts: DataFrame, within: list[str], digit: str) -> DataFrame:
    """counts with the values of lower digits of the same group as ``below``; a group has some thousand rows at most."""
    w = Window.partitionBy(*within).orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("below", F.coalesce(F.sum("n").over(w), F.lit(0)))


def exact_quantiles(df: DataFrame, value: str, levels: Sequence[float], keys: Sequence[str], gathered: int = GATHERED) -> DataFrame:
    """(keys, n, q): the number of values and an array of their quantiles, interpolated between neighbours as Spark's ``percentile`` does.

    Null values do not count; a key without any has no row; null keys are one key.  df is read once a pass, so it
    should be cheap to read (a table or a checkpoint).
    """
    if not all(0 <= p <= 1 for p in levels):
        raise ValueError("levels lie between 0 and 1")
    k = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(c).alias(a) for c, a in zip(keys, k)), F.col(value).cast("double").alias("v")).filter("v is not null")
    counts = checkpoint(rows.groupBy(*k, leading_digit(F.col("v")).alias("d")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")))
    sizes = counts.groupBy(*k).agg(F.sum("n").alias("size"))
    at = [(F.col("size") - 1) * p for p in levels]
    ranks = F.array_distinct(F.array(*(f(h).cast("long") for h in at for f in (F.floor, F.ceil))))
    wanted = sizes.select(*k, "size", F.explode(ranks).alias("rank"))
    # (keys, size, rank, below, n, low, high): the digit that holds each rank
    places = _cumulated(counts, k, "d").select(*(F.col(c).alias(f"o{c}") for c in k), "below", "n", "low", "high")
    held = (F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("n"))
    spots = checkpoint(wanted.join(places, _same(k, [f"o{c}" for c in k]) & held).select(*k, "size", "rank", "below", "n", "low", "high"))
    crowded = (F.col("n") > gathered) & (F.col("low") < F.col("high"))
    while True:
        wide = spots.filter(crowded)
        if wide.isEmpty():
            break
        pieces = wide.select(*(F.col(c).alias(f"o{c}") for c in k), F.col("low").alias("from"), F.col("high").alias("to")).distinct()
        inside = rows.join(small(pieces), _same(k, [f"o{c}" for c in k]) & F.col("v").between(F.col("from"), F.col("to")))
        cut = inside.groupBy(*k, "from", _finer(F.col("v"), F.col("from"), F.col("to")).alias("d")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        fine = _cumulated(cut, [*k, "from"], "d").select(*(F.col(c).alias(f"o{c}") for c in k), "from", F.col("below").alias("less"), F.col("n").alias("m"), F.col("low").alias("l"), F.col("high").alias("h"))
        in_piece = (F.col("below") + F.col("less") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("less") + F.col("m"))
        met = wide.join(fine, _same(k, [f"o{c}" for c in k]) & (F.col("low") == F.col("from")) & in_piece)
        found = met.select(*k, "size", "rank", (F.col("below") + F.col("less")).alias("below"), F.col("m").alias("n"), F.col("l").alias("low"), F.col("h").alias("high"))
        spots = checkpoint(spots.filter(~crowded).unionByName(found))
    single = spots.filter("low = high").select(*k, "size", "rank", F.col("low").alias("x"))
    open_ = spots.filter("low < high")
    pieces = open_.select(*(F.col(c).alias(f"o{c}") for c in k), F.col("low").alias("from"), F.col("high").alias("to")).distinct()
    inside = rows.join(small(pieces), _same(k, [f"o{c}" for c in k]) & F.col("v").between(F.col("from"), F.col("to")))
    few = inside.groupBy(*(F.col(c).alias(f"o{c}") for c in k), "from").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    read = open_.join(few, _same(k, [f"o{c}" for c in k]) & (F.col("low") == F.col("from"))).select(*k, "size", "rank", F.get("vs", (F.col("rank") - F.col("below")).cast("int")).alias("x"))
    by_rank = single.unionByName(read).groupBy(*k).agg(F.first("size").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("x"))

    def between(p: float) -> Column:
        h = (F.col("n") - 1) * p
        low, high = F.floor(h).cast("long"), F.ceil(h).cast("long")
        a, b = F.element_at("x", low), F.element_at("x", high)
        return F.when((low == high) | (a == b), a).otherwise((high - h) * a + (h - low) * b)

    return by_rank.select(*(F.col(a).alias(c) for a, c in zip(k, keys)), "n", F.array(*map(between, levels)).alias("q"))
