"""Daily price files as they come: marks before the header, odd spaces, two date formats, dividends among prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("date", "open", "high", "low", "close", "adj_close", "volume")
#: The date formats of price files.
DATE_FORMATS = ("d-MMM-yy", "yyyy-MM-dd")


def _number(name: str):
    return F.regexp_replace(F.trim(F.translate(F.col(name), "\u00a0", " ")), ",", "").try_cast("double")


def read_price_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(prices, corporate actions, rejected files) of all CSV files under a path or glob; the file's name is the ticker.

    Files are read as lines, so each may order its columns in its own way; a file that lacks a
    required column is reported in the third table and otherwise left out.  Headers are read at once, to
    learn how many cells rows may have.  Rows of dividends go to the second.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    ticker = F.regexp_extract("file", r"([^/]+)\.[^./]*$", 1)
    looks = F.lower(F.translate("value", "\ufeff\u00a0", "  ")).rlike(r"^\s*\"?date\s*\"?\s*,")
    header = lines.filter(looks).groupBy("file").agg(F.first("value").alias("header"))
    names = F.transform(F.split("header", ","), lambda h: F.regexp_replace(F.lower(F.btrim(h, F.lit(" \u00a0\ufeff\t\"\r"))), "[\\s\u00a0]+", "_"))
    headed = header.select("file", names.alias("names"))
    width = max(len(REQUIRED), headed.agg(F.coalesce(F.max(F.size("names")), F.lit(0)).alias("n")).first()["n"])  # the widest header
    cells = F.from_csv("value", ", ".join(f"c{i} string" for i in range(width)), {"mode": "PERMISSIVE"})
    lacking = headed.select("file", F.array_except(F.array(*map(F.lit, REQUIRED)), "names").alias("missing"))
    files = lines.select("file").distinct().join(lacking, "file", "left")
    rejected = files.filter(F.col("missing").isNull() | (F.size("missing") > 0)).select(ticker.alias("ticker"), F.coalesce(F.array_join("missing", ", "), F.lit("header")).alias("missing"))
    rows = lines.filter(~looks & (F.length(F.trim("value")) > 0)).join(headed, "file").select("file", "names", cells.alias("c"))
    rows = rows.select("file", "names", F.array(*(F.col("c")[f"c{i}"] for i in range(width))).alias("cells"))
    cell = lambda n: F.when(F.array_contains("names", n), F.get("cells", (F.array_position("names", n) - 1).cast("int")))
    named = rows.select("file", *(cell(n).alias(n) for n in REQUIRED))
    good = named.join(files.filter(F.size("missing") == 0).select("file"), "file", "left_semi")
    day = F.coalesce(*(F.to_date(F.try_to_timestamp(F.trim("date"), F.lit(f))) for f in DATE_FORMATS))
    dividend = F.regexp_extract("open", "^\\s*([0-9.]+)[\\s\u00a0]+Dividend", 1)
    typed = good.select(ticker.alias("ticker"), day.alias("date"), *(_number(c).alias(c) for c in REQUIRED[1:6]), _number("volume").try_cast("bigint").alias("volume"), dividend.alias("dividend"))
    prices = typed.filter((F.coalesce("dividend", F.lit("")) == "") & F.col("date").isNotNull()).drop("dividend")
    actions = typed.filter(F.col("dividend") != "").select("ticker", "date", F.col("dividend").cast("double").alias("amount"))
    return prices, actions, rejected
