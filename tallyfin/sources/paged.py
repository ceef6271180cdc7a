"""Tables behind an endpoint that gives pages: a data source with schema, pages by cursor, pushed filters and retries.

An endpoint is a folder (local or of any file system that Arrow can open) or an http address with an
``index.json`` and its pages.  The index has the table's schema as Spark writes it in JSON and, for each page, its cursor, number of rows
and the bounds of each column; a page is ``page-<cursor>.json``: {"data": [[...], ...]} in the
index's order of columns.  Filters that Spark pushes leave pages out by their bounds before anything of
them is fetched, and rows within the pages.  A fetch that fails, or a page with
another number of rows than promised, is asked for again.

    register(spark)
    spark.read.format("paged_table").option("columns", "ticker,close").load(endpoint).filter("close > 3")
"""

from __future__ import annotations

import datetime as dt
import json
import time
import urllib.request
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DateType, DecimalType, DoubleType, FloatType, StructType, TimestampNTZType, TimestampType

#: Pages of one task, times that a page is asked for, seconds before the second time (doubled after each).
PAGES, TRIES, PAUSE = 4, 4, 0.2
#: Filters by the comparison that they are, as pyarrow names it.
COMPARED = {EqualTo: "equal", GreaterThan: "greater", GreaterThanOrEqual: "greater_equal", LessThan: "less", LessThanOrEqual: "less_equal"}


def _file_system(endpoint: str):
    from pyarrow import fs

    if endpoint.startswith("file:") and not endpoint.startswith("file://"):
        endpoint = endpoint.removeprefix("file:")
    return fs.FileSystem.from_uri(endpoint)


def fetch(endpoint: str, name: str) -> bytes:
    if endpoint.startswith(("http://", "https://")):
        with urllib.request.urlopen(f"{endpoint}/{name}", timeout=60) as answer:
            return answer.read()
    system, folder = _file_system(endpoint)
    with system.open_input_stream(f"{folder}/{name}") as f:
        return f.read()


def fetch_again(endpoint: str, name: str, whole, tries: int, pause: float):
    """The parsed answer, asked for until ``whole`` accepts it; the last fault is raised."""
    for k in range(tries):
        try:
            answer = json.loads(fetch(endpoint, name))
            if not whole(answer):
                raise ValueError(f"{name}: not the rows that the index promises")
            return answer
        except (OSError, ValueError):
            if k == tries - 1:
                raise
            time.sleep(pause * 2**k)


def _plain(value):
    """A value as a page writes it."""
    return value.isoformat() if isinstance(value, (dt.date, dt.datetime)) else value


@dataclass
class Pages(InputPartition):
    cursors: list[tuple[str, int]]

    def __init__(self, cursors):
        self.cursors = cursors


class PagedTable(DataSource):
    """Options: path (the endpoint), columns (of those wanted, by comma), pages (of a task), tries, pause."""

    @classmethod
    def name(cls) -> str:
        return "paged_table"

    def _index(self) -> dict:
        o = self.options
        return fetch_again(o["path"], "index.json", lambda a: "pages" in a and "schema" in a, int(o.get("tries", TRIES)), float(o.get("pause", PAUSE)))

    def schema(self) -> StructType:
        every = StructType.fromJson(self._index()["schema"])
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        if unknown := [c for c in wanted if c not in every.names]:
            raise ValueError(f"no such columns: {unknown}")
        return StructType([every[c] for c in wanted]) if wanted else every

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, dict(self.options), self._index())


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict, index: dict):
        self.schema, self.options, self.index, self.pushed = schema, options, index, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of exact types are taken over whole; Spark does the others."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            inexact = name not in self.schema.names or isinstance(self.schema[name].dataType, (DoubleType, FloatType, DecimalType, TimestampType, TimestampNTZType))
            if isinstance(f, IsNotNull) and name in self.schema.names:
                self.pushed.append((name, "not_null", None))
            elif not inexact and type(f) in COMPARED:
                self.pushed.append((name, COMPARED[type(f)], f.value))
            elif not inexact and isinstance(f, In):
                self.pushed.append((name, "in", list(f.value)))
            else:
                yield f

    def _may_hold(self, bounds: dict) -> bool:
        """False where the page's bounds rule out all its rows; bounds of a column without values are null."""
        for name, how, wanted in self.pushed:
            if name not in bounds:
                continue
            if bounds[name] is None:
                return False
            low, high = bounds[name]
            w = [_plain(x) for x in wanted if x is not None] if how == "in" else _plain(wanted)
            if (
                (how == "equal" and not low <= w <= high) or (how == "greater" and high <= w) or (how == "greater_equal" and high < w)
                or (how == "less" and low >= w) or (how == "less_equal" and low > w) or (how == "in" and not any(low <= x <= high for x in w))
            ):
                return False
        return True

    def partitions(self) -> Sequence[InputPartition]:
        cursors = [(p["cursor"], p["rows"]) for p in self.index["pages"] if self._may_hold(p.get("bounds", {}))]
        each = int(self.options.get("pages", PAGES))
        return [Pages(cursors[i : i + each]) for i in range(0, len(cursors), each)] or [Pages([])]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        every = StructType.fromJson(self.index["schema"])
        target = to_arrow_schema(self.schema)
        tries, pause = int(self.options.get("tries", TRIES)), float(self.options.get("pause", PAUSE))
        for cursor, rows in partition.cursors:
            data = fetch_again(self.options["path"], f"page-{cursor}.json", lambda a: len(a.get("data", ())) == rows, tries, pause)["data"]  # noqa: B023
            columns = []
            for field in target:
                at, kind = every.names.index(field.name), self.schema[field.name].dataType
                values = pa.array([r[at] for r in data], pa.string() if isinstance(kind, (DateType, TimestampType, TimestampNTZType)) else field.type)
                columns.append(values.cast(field.type))
            table = pa.Table.from_arrays(columns, schema=target)
            for name, how, wanted in self.pushed:
                column, kind = table[name], target.field(name).type
                keep = pc.is_valid(column) if how == "not_null" else pc.is_in(column, pa.array(wanted, kind)) if how == "in" else pc.call_function(how, [column, pa.scalar(wanted, kind)])
                table = table.filter(keep)
            yield from table.to_batches()


def register(spark: SparkSession) -> None:
    """Make the format known and let Spark push filters to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedTable)


def write_pages(df: DataFrame, endpoint: str, rows: int = 10_000) -> int:
    """Write df as an endpoint's pages of at most so many rows, a task at a time, then the index; how many pages there are.

    Names come from a task's partition, so a task that runs again writes the same files.  Of floating
    point values only finite ones are allowed.
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, folder = _file_system(endpoint)
        system.create_dir(folder, recursive=True)
        part, held, pages = TaskContext.get().partitionId(), [], []

        def write() -> None:
            page, held[:] = held[:rows], held[rows:]
            columns = [[_plain(v) for v in c] for c in zip(*page)]
            bounds = {}
            for name, c in zip(names, columns):
                told = [v for v in c if v is not None]
                bounds[name] = [min(told), max(told)] if told else None
            cursor = f"{part:06d}-{len(pages):06d}"
            with system.open_output_stream(f"{folder}/page-{cursor}.json") as f:
                f.write(json.dumps({"data": list(map(list, zip(*columns)))}, allow_nan=False).encode())
            pages.append(json.dumps({"cursor": cursor, "rows": len(page), "bounds": bounds}))

        for batch in batches:
            held += [tuple(r.values()) for r in batch.to_pylist()]
            while len(held) >= rows:
                write()
        if held:
            write()
        yield pa.RecordBatch.from_arrays([pa.array(pages, pa.string())], ["page"])

    index = sorted((json.loads(r["page"]) for r in df.mapInArrow(run, "page string").collect()), key=lambda p: p["cursor"])
    system, folder = _file_system(endpoint)
    system.create_dir(folder, recursive=True)
    with system.open_output_stream(f"{folder}/index.json") as f:
        f.write(json.dumps({"schema": df.schema.jsonValue(), "pages": index}).encode())
    return len(index)


def scan_pages(spark: SparkSession, endpoint: str, columns: list[str] | None = None, where: dict[str, object] | None = None, as_of: tuple[str, str] | None = None) -> DataFrame:
    """As ``tables.scan``, of an endpoint: rows with the wanted values (a list: any of them) up to a day, only the columns asked for and those that filters need are kept of a page."""
    register(spark)
    needed = dict.fromkeys([*(columns or []), *(where or {}), *([as_of[0]] if as_of else [])]) if columns else {}
    df = spark.read.format("paged_table").option("columns", ",".join(needed)).load(endpoint)
    for column, wanted in (where or {}).items():
        df = df.filter(F.col(column).isin(list(wanted)) if isinstance(wanted, (list, tuple, set)) else F.col(column) == wanted)
    if as_of:
        df = df.filter(F.col(as_of[0]) <= F.to_date(F.lit(as_of[1])))
    return df.select(*columns) if columns else df
