"""Multiples, dividend and asset models, and the parts of a discounted cash flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(a, b)


def multiples(df: DataFrame) -> DataFrame:
    """Adds pe, pb, ps, ev_ebitda and peg; df: (price, eps, book_per_share, sales_per_share, enterprise_value, ebitda, growth_percent).  Null over zero."""
    return df.withColumns({
        "pe": ratio("price", "eps"), "pb": ratio("price", "book_per_share"), "ps": ratio("price", "sales_per_share"),
        "ev_ebitda": ratio("enterprise_value", "ebitda"), "peg": F.try_divide(ratio("price", "eps"), F.col("growth_percent")),
    })


def dividend_value(dividend: Column, growth: Column, required: Column) -> Column:
    """Next dividend over the required return less growth; null unless it exceeds growth."""
    return F.when(required > growth, dividend * (1 + growth) / (required - growth))


def asset_value(assets: Column, liabilities: Column, shares: Column) -> Column:
    return F.try_divide(assets - liabilities, shares)


def free_cash_flow_to_equity(net_income: Column, depreciation: Column, capex: Column, working_capital: Column, borrowing: Column) -> Column:
    return net_income + depreciation - capex - working_capital + borrowing


def comparables(df: DataFrame, multiple: str, metric: str, group: str) -> DataFrame:
    """Adds implied_value: the group's median multiple times the metric."""
    medians = df.groupBy(group).agg(F.median(multiple).alias("median_multiple"))
    return df.join(medians, group).withColumn("implied_value", F.col("median_multiple") * F.col(metric))


def weighted_cost_of_capital(equity: Column, debt: Column, cost_of_equity: Column, cost_of_debt: Column, tax: Column) -> Column:
    total = equity + debt
    return F.try_divide(equity, total) * cost_of_equity + F.try_divide(debt, total) * cost_of_debt * (1 - tax)


def projected(df: DataFrame, years: int = 5, metric: str = "fcf", growth: str = "growth") -> DataFrame:
    """A row for each coming year with the metric compounded."""
    out = df.withColumn("year", F.explode(F.sequence(F.lit(1), F.lit(years))))
    return out.withColumn("projected", F.col(metric) * F.pow(1 + F.col(growth), F.col("year").cast("double")))


def terminal_value(last: Column, growth: Column, wacc: Column) -> Column:
    return F.try_divide(last * (1 + growth), wacc - growth)


def discounted(cash: Column, wacc: Column, year: Column) -> Column:
    return cash / F.pow(1 + wacc, year.cast("double"))


def historical_metrics(df: DataFrame, keys: str = "ticker", order: str = "calendardate") -> DataFrame:
    """(keys, periods, mean_growth, std_growth, last_value) of a metric's changes; df: (keys, order, value)."""
    from tallyfin.functions.series import ordered, simple_return

    grown = df.withColumn("_g", simple_return(F.col("value"), ordered(keys, order)))
    return grown.groupBy(keys).agg(F.count("_g").alias("periods"), F.avg("_g").alias("mean_growth"), F.stddev_samp("_g").alias("std_growth"), F.max_by("value", order).alias("last_value"))


def sensitivity(df: DataFrame, waccs: tuple[float, ...] = (0.08, 0.09, 0.10, 0.11, 0.12), growths: tuple[float, ...] = (0.01, 0.02, 0.03, 0.04)) -> DataFrame:
    """A row for each WACC and terminal growth of the grid, which is literal and so joins nothing."""
    grid = F.array(*(F.struct(F.lit(w).alias("wacc"), F.lit(g).alias("terminal_growth")) for w in waccs for g in growths))
    return df.withColumn("_cell", F.explode(grid)).withColumns({"wacc": F.col("_cell.wacc"), "terminal_growth": F.col("_cell.terminal_growth")}).drop("_cell")
