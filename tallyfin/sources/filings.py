"""Folders of paged documents, read as binary files by an extractor of the caller's choice, and their conversion to markdown.

A document that cannot be read is a row of its own with the error, and stops no other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfin.operators import textclean

#: An extractor takes a file's bytes and gives, page by page, its text and tables (lists of rows of cells).
Extractor = Callable[[bytes], list[tuple[str, list[list[list[str]]]]]]

_TABLES = pa.list_(pa.list_(pa.list_(pa.string())))
PAGES = "doc string, page int, text string, tables array<array<array<string>>>, error string"


def form_feed_pages(content: bytes) -> list[tuple[str, list[list[list[str]]]]]:
    """Plain text, UTF-8, with pages parted by form feeds and no tables."""
    return [(page, []) for page in content.decode("utf-8").split("\f")]


def read_filings(spark: SparkSession, path: str, extract: Extractor = form_feed_pages, pattern: str = "*", suffix: str = "") -> DataFrame:
    """(doc, page, text, tables, error): pages from 1 of every file of a folder; doc is the file's name without its suffix.

    A file whose extraction raises gives one row with null page and the error.  Spark reads the files,
    one at a time in a worker's memory, wherever they are.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern + suffix)
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    pages, error = extract(content.as_py()), None
                except Exception as e:  # any fault of a document is its own
                    pages, error = [], f"{type(e).__name__}: {e}"
                rows = [(doc, k, text, tables, None) for k, (text, tables) in enumerate(pages, 1)] or [(doc, None, None, None, error)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.string(), _TABLES, pa.string()))], ["doc", "page", "text", "tables", "error"])

    return reader.load(path).select(name.alias("doc"), "content").mapInArrow(run, PAGES)


def convert(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, markdown) of the documents that were read, and (doc, status, pages, n_tables, warnings) of all; pages: as read_filings gives them."""
    read = pages.filter("error is null and page is not null")
    tables = read.select("doc", "page", F.posexplode("tables").alias("pos", "rows"))
    markdown = textclean.assemble(read, textclean.strip_repeated(read, textclean.repeated_lines(read)), tables)
    report = textclean.quality_report(read, tables)
    blank = read.groupBy("doc").agg(F.max(F.length(textclean.stripped(F.coalesce("text", F.lit("")))) > 0).alias("said"))
    told = report.join(blank, "doc").select(
        "doc", F.lit("converted").alias("status"), "pages", "n_tables",
        F.array_join(F.array_compact(F.array(F.when(~F.col("said"), F.lit("no text")), F.when(F.col("warnings") != "", F.col("warnings")), F.when(F.col("n_tables") == 0, F.lit("no tables")))), "; ").alias("warnings"),
    )
    failed = pages.filter("error is not null or page is null").select("doc", F.lit("failed").alias("status"), F.lit(0).cast("long").alias("pages"), F.lit(0).cast("long").alias("n_tables"), F.coalesce("error", F.lit("no pages")).alias("warnings"))
    return markdown, told.unionByName(failed)
