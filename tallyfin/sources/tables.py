"""Market-like tables made of the star schema and the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan(
    spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None, where: dict[str, object] | None = None, as_of: tuple[str, str] | None = None
) -> DataFrame:
    """Rows of a table whose columns have the wanted values (a list: any of them), up to a day of a date column; only the columns asked for.

    Filters and columns are plain, so both reach the files.  An unknown column raises.
    """
    df = table(spark, sf_dir, name)
    for column, wanted in (where or {}).items():
        df = df.filter(F.col(column).isin(list(wanted)) if isinstance(wanted, (list, tuple, set)) else F.col(column) == wanted)
    if as_of:
        df = df.filter(F.col(as_of[0]) <= F.to_date(F.lit(as_of[1])))
    return df.select(*columns) if columns else df


def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, ts, open, high, low, close, volume): an hour's events of one type; first and last by event_id, of the values that are not null.

    Of rows that share an event_id the one nearest the start of its file counts, at either end.
    """
    e = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value", F.col("_metadata.row_index").alias("_row"))
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    known = F.col("event_id").isNotNull() & F.col("value").isNotNull()
    first, last = (F.when(known, F.struct("event_id", row.alias("row"))) for row in (F.col("_row"), -F.col("_row")))
    return e.groupBy(F.col("event_type").alias("ticker"), hour.alias("ts")).agg(
        F.min_by("value", first).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", last).alias("close"), F.count("*").alias("volume")
    )


def bars_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As bars_hourly, of a week's order prices of one priority; (ticker, date, ...)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    week = F.to_date(F.date_trunc("week", "o_orderdate"))
    at = F.struct("o_orderdate", "o_orderkey")
    return o.groupBy(F.col("o_orderpriority").alias("ticker"), week.alias("date")).agg(
        F.min_by("o_totalprice", at).alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", at).alias("close"), F.count("*").alias("volume")
    )


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, calendardate, roic, fcfps, ebitdausd, grossmargin, shareswadil, epsusd) of a nation's quarter."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    sold = line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).join(customer, F.col("o_custkey") == customer["c_custkey"]).join(nation, F.col("c_nationkey") == nation["n_nationkey"])
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return sold.groupBy(F.col("n_name").alias("ticker"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("calendardate")).agg(
        F.try_divide(F.sum(net), F.sum("l_extendedprice")).alias("roic"), F.try_divide(F.sum(net), F.sum("l_quantity")).alias("fcfps"), F.sum(net * (1 + F.col("l_tax"))).alias("ebitdausd"),
        (1 - F.avg("l_discount")).alias("grossmargin"), F.sum("l_quantity").alias("shareswadil"), F.avg(F.try_divide(net, F.col("l_quantity"))).alias("epsusd"),
    )


def tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, sector): nations and their regions."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_name").alias("ticker"), F.col("r_name").alias("sector"))


def daily_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, close): a nation's mean order price of a day."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    bought = orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(nation, F.col("c_nationkey") == nation["n_nationkey"])
    return bought.groupBy(F.col("n_name").alias("ticker"), F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("close"))


def filing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, page, text): documents as the pages of their source."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
