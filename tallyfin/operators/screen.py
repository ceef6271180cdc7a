"""The fundamentals screen: changes of quarterly metrics, rules, criteria, horizon averages and the joined result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfin.functions import series as s

#: Metrics whose change between quarters is watched, by short name.
METRICS = {"roic": "roic", "fcfps": "fcfps", "ebitda": "ebitdausd", "grossmarg": "grossmargin", "sharesout": "shareswadil"}
#: Multiple, rate and yield of the intrinsic value; horizons in months.
MULTIPLE, TREASURY_RATE, CORPORATE_YIELD = 8.5, 3.0, 5.0
HORIZONS = (1, 3, 6, 9, 12)


def changes(f: DataFrame, order: str = "calendardate", keys: str = "ticker") -> DataFrame:
    """Adds NAME_delta, NAME_delta_shift1 and NAME_delta_shift2 of each metric, within each key."""
    w = s.ordered(keys, order)
    deltas = f.select("*", *(s.simple_return(F.col(c), w).alias(f"{n}_delta") for n, c in METRICS.items()))
    return deltas.select("*", *(F.lag(f"{n}_delta", k).over(w).alias(f"{n}_delta_shift{k}") for n in METRICS for k in (1, 2)))


def rules(changed: DataFrame) -> DataFrame:
    """Adds roic_incr, fcfps_incr, ebitda_incr, grossmarg_incr and sharesout_decr; a missing change makes a rule false."""

    def chain(n: str, rising: bool) -> Column:
        a, b, c = F.col(f"{n}_delta"), F.col(f"{n}_delta_shift1"), F.col(f"{n}_delta_shift2")
        return F.coalesce((a > b) & (b > c) if rising else (a <= b) & (b <= c), F.lit(False))

    return changed.select("*", *(chain(n, True).alias(f"{n}_incr") for n in METRICS if n != "sharesout"), chain("sharesout", False).alias("sharesout_decr"))


def intrinsic_value(f: DataFrame, order: str = "calendardate", keys: str = "ticker", window: int = 5) -> DataFrame:
    """Adds growth_rate (ten times the mean change of earnings over the window) and intrinsic_value."""
    w = s.ordered(keys, order)
    made = f.withColumn("_eps_change", s.simple_return(F.col("epsusd"), w))
    made = made.withColumn("growth_rate", s.rolling_mean(F.col("_eps_change"), w, window) * 10).drop("_eps_change")
    return made.withColumn("intrinsic_value", F.col("epsusd") * (MULTIPLE + 2 * F.col("growth_rate") * TREASURY_RATE) / CORPORATE_YIELD)


def criteria(ruled: DataFrame, order: str = "calendardate", keys: str = "ticker") -> DataFrame:
    """(keys, order, criterion, intrinsic_value): a row for each criterion from 1 to 5 that a quarter meets."""
    met = {
        1: F.col("roic_incr"), 2: F.col("fcfps_incr"), 3: F.col("ebitda_incr"),
        4: F.col("fcfps_incr") & F.col("grossmarg_incr"), 5: F.col("fcfps_incr") & F.col("sharesout_decr"),
    }
    listed = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in met.items())))
    return ruled.select(keys, order, F.explode(listed).alias("criterion"), "intrinsic_value")


def final_tickers(picks: DataFrame, order: str = "calendardate", keys: str = "ticker") -> DataFrame:
    """(order, keys): picks of criterion 1, and those of 2 that are picks of neither 1 nor 3."""
    flags = picks.groupBy(order, keys).agg(*(F.bool_or(F.col("criterion") == k).alias(f"c{k}") for k in (1, 2, 3)))
    return flags.filter("c1 or (c2 and not c3)").select(order, keys)


def latest(df: DataFrame, order: str = "calendardate") -> DataFrame:
    """Rows of the last date of all."""
    return df.join(F.broadcast(df.agg(F.max(order).alias(order))), order, "left_semi")


def horizon_averages(prices: DataFrame, starts: DataFrame, order: str = "date", keys: str = "ticker", width_days: int = 30) -> DataFrame:
    """(keys, start, fwd_N...): mean closes of the month that ends N months after each start, both ends included.

    starts: (keys, start).  A start meets only the days of the calendar months that its windows touch.
    """
    month = lambda day: F.year(day) * 12 + F.month(day)
    ends = starts.distinct().select(keys, "start", F.explode(F.array(*map(F.lit, HORIZONS))).alias("n"))
    ends = ends.select(keys, "start", "n", F.add_months("start", F.col("n")).alias("to")).withColumn("from", F.date_sub("to", width_days))
    ends = ends.withColumn("month", F.explode(F.sequence(month("from"), month("to"))))
    days = prices.select(keys, F.col(order).alias("day"), "close", month(order).alias("month"))
    met = ends.join(days, [keys, "month"]).filter(F.col("day").between(F.col("from"), F.col("to")))
    means = met.groupBy(keys, "start").agg(*(F.avg(F.when(F.col("n") == n, F.col("close"))).alias(f"fwd_{n}") for n in HORIZONS))
    return starts.distinct().join(means, [keys, "start"], "left")


def rolling_averages(prices: DataFrame, windows: tuple[int, ...] = (15, 30, 45), order: str = "date", keys: str = "ticker") -> DataFrame:
    w = s.ordered(keys, order)
    return prices.select(keys, order, "close", *(s.rolling_mean(F.col("close"), w, n).alias(f"avg_{n}") for n in windows))


def point_in_time(df: DataFrame, as_of: Column, order: str = "date", keys: str = "ticker", exact: bool = True) -> DataFrame:
    """Rows of the day itself; with ``exact`` off, each key's last row up to it."""
    if exact:
        return df.filter(F.col(order) == as_of)
    rank = F.row_number().over(Window.partitionBy(keys).orderBy(F.desc(order)))
    return df.filter(F.col(order) <= as_of).withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def screen_result(final: DataFrame, averages: DataFrame, metadata: DataFrame, picks: DataFrame, forward: DataFrame, keys: str = "ticker") -> DataFrame:
    """All five criteria's results in one table: prices at the date, metadata, picks and forward averages meet on the key.

    A pick survives only if its ticker is among the final ones.  Duplicates go; Catalyst broadcasts sides whose size allows it.
    """
    held = averages.join(final.select(keys).distinct(), keys, "left_semi")
    return held.join(metadata, keys).join(picks.select(keys, "criterion", "intrinsic_value"), keys).join(forward, keys).dropDuplicates()
