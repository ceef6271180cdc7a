"""As-of joins of irregular series: each row with the last row of another table up to its time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _number(column: str, kind: T.DataType) -> Column:
    """A time as a number that orders alike."""
    c = F.col(column)
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    return c.cast("double")


def asof_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str] | str, order: str, right_order: str | None = None, columns: Sequence[str] | None = None,
    tolerance: Column | None = None, exact: bool = True, matched: str = "matched", blocks: int | None = None,
) -> DataFrame:
    """Every row of left with ``columns`` of the last row of right whose keys are equal and whose time is not after its own, and that time as ``matched``.

    With ``exact`` off the time must be before.  A match further back than ``tolerance`` (what may be added to
    a time) counts as none.  Of right's rows of one key and time the greatest by its columns in turn is
    taken.  A null key or time on either side matches nothing; left rows without a match keep nulls.  ``columns`` are
    all of right but keys and time if not given; a name that left has as well raises.

    The span of time is cut into ``blocks`` ranges (the session's shuffle partitions without it), and a
    key's rows of one range are a window's partition, so a hot key is as many tasks' as there are
    ranges.  The last row of each key and range is aggregated beforehand, and the latest of the ranges before is put first
    among a range's rows: a carry of at most keys times ranges small rows.
    """
    k, at = [keys] if isinstance(keys, str) else list(keys), right_order or order
    columns = list(columns) if columns is not None else [c for c in right.columns if c not in (*k, at)]
    if clash := {c.lower() for c in (*columns, matched)} & {c.lower() for c in left.columns}:
        raise ValueError(f"columns of both tables: {sorted(clash)}")
    blocks = blocks or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = left.schema[order].dataType
    names = [f"_k{i}" for i in range(len(k))]
    told = F.col(at).isNotNull()
    for c in k:
        told = told & F.col(c).isNotNull()
    row = F.struct(F.col(at).alias("_t"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(columns)))
    r = right.filter(told).select(*(F.col(c).alias(n) for c, n in zip(k, names)), F.col(at).alias("_t"), _number(at, right.schema[at].dataType).alias("_x"), row.alias("_row"))
    mine = left.select(*(F.col(c).alias(n) for c, n in zip(k, names)), F.col(order).alias("_t"), _number(order, kind).alias("_x"), F.struct(*(F.col(f"`{c}`") for c in left.columns)).alias("_mine"))
    ends = r.select("_x").unionByName(mine.select("_x")).agg(F.min("_x").alias("low"), F.max("_x").alias("high")).first()
    wide = (ends["high"] - ends["low"]) / blocks if ends["low"] is not None and ends["high"] > ends["low"] else 1.0
    part = F.floor((F.col("_x") - (ends["low"] or 0.0)) / wide).cast("int")
    r, mine = r.select("*", part.alias("_part")), mine.select("*", part.alias("_part"))

    none_row, none_mine = F.lit(None).cast(r.schema["_row"].dataType), F.lit(None).cast(mine.schema["_mine"].dataType)
    both = r.select(*names, "_part", "_row", F.lit(0).alias("_asks")).unionByName(mine.select(*names, "_part", none_row.alias("_row"), F.lit(1).alias("_asks")))
    tops = both.groupBy(*names, "_part").agg(F.max("_row").alias("_top"), F.max("_asks").alias("_asks"))
    before = Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = tops.withColumn("_row", F.max("_top").over(before)).filter("_asks = 1 and _row is not null")

    asks = 1 if exact else 0  # where a left row stands among right rows of its time
    rows = (
        mine.select(*names, "_part", "_t", F.lit(asks).alias("_side"), none_row.alias("_row"), "_mine")
        .unionByName(r.select(*names, "_part", "_t", F.lit(1 - asks).alias("_side"), "_row", none_mine.alias("_mine")))
        .unionByName(carry.select(*names, "_part", F.col("_row._t").alias("_t"), F.lit(1 - asks).alias("_side"), "_row", none_mine.alias("_mine")))
    )
    w = Window.partitionBy(*names, "_part").orderBy("_t", "_side", "_row").rowsBetween(Window.unboundedPreceding, 0)
    met = rows.withColumn("_last", F.last("_row", ignorenulls=True).over(w)).filter(F.col("_side") == asks).filter("_mine is not null")
    if tolerance is not None:
        met = met.withColumn("_last", F.when(F.col("_last._t") + tolerance >= F.col("_t"), F.col("_last")))
    return met.select("_mine.*", *(F.col(f"_last._{i}").alias(c) for i, c in enumerate(columns)), F.col("_last._t").alias(matched))
