"""Writers: partitioned tables, one text per document, and the skipping of what is written already."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_by_criterion(picks: DataFrame, path: str) -> None:
    """A folder for each criterion, where a workbook would have a sheet."""
    picks.write.mode("overwrite").partitionBy("criterion").parquet(path)


def write_report(lines: DataFrame, path: str) -> None:
    """The report's lines in order (section, ticker, its own figures and then its scenarios by name), in one file; a report has a few lines a ticker."""
    shown = F.when(F.col("scenario") == "", F.concat("ticker", F.lit(": "), "line")).otherwise(F.concat(F.lit("  "), "scenario", F.lit(": "), "line"))
    lines.orderBy("section", "ticker", "scenario").select(shown.alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_documents(markdown: DataFrame, path: str) -> None:
    markdown.write.mode("append").parquet(path)


def not_yet_done(documents: DataFrame, done: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents whose key is not among those done."""
    return documents.join(done.select(F.col(key)).distinct(), key, "left_anti")
