"""As-of joins by brute force; pages with pushed filters, retries and odd values."""

import datetime as dt
import http.server
import json
import random
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual

from tallyfin.operators.asof import asof_join
from tallyfin.sources import paged

DAY = dt.date(2024, 1, 1)


def brute(left, right, exact=True, tolerance=None):
    out = []
    for k, t, x in left:
        best = max(((u, v) for j, u, v in right if j is not None and j == k and u is not None and t is not None and (u <= t if exact else u < t)), default=None)
        if best and tolerance is not None and (t - best[0]).days > tolerance:
            best = None
        out.append((k, t, x, *((best[1], best[0]) if best else (None, None))))
    return sorted(map(str, out))


@pytest.fixture(scope="module")
def two(spark):
    rng = random.Random(4)
    day = lambda: DAY + dt.timedelta(rng.randrange(400))
    left = [(rng.choice("aaaaab"), day(), i) for i in range(300)] + [("c", day(), 900), (None, day(), 901), ("a", None, 902)] + [("a", DAY, 903)] * 3
    right = [(rng.choice("aaab"), day(), float(i)) for i in range(120)] + [("a", DAY + dt.timedelta(50), 5.0)] * 2 + [("a", DAY + dt.timedelta(50), 6.0), (None, DAY, 1.0), ("a", None, 2.0)]
    return left, right, spark.createDataFrame(left, "k string, t date, x int").repartition(3), spark.createDataFrame(right, "k string, u date, v double").repartition(3)


@pytest.mark.parametrize("blocks", [1, 5, 500])
@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("tolerance", [None, 3])
def test_asof_by_brute_force(two, blocks, exact, tolerance):
    left, right, l, r = two
    within = None if tolerance is None else F.expr(f"interval {tolerance} days")
    got = asof_join(l, r, "k", "t", "u", exact=exact, tolerance=within, blocks=blocks)
    assert got.columns == ["k", "t", "x", "v", "matched"]
    assert sorted(str(tuple(x)) for x in got.collect()) == brute(left, right, exact, tolerance)


def test_asof_of_nothing_and_of_clashing_names(two):
    *_, l, r = two
    assert asof_join(l, r.limit(0), "k", "t", "u").filter("matched is not null").count() == 0 and asof_join(l, r.limit(0), "k", "t", "u").count() == l.count()
    assert asof_join(l.limit(0), r, "k", "t", "u").count() == 0
    with pytest.raises(ValueError):
        asof_join(l, r.withColumnRenamed("v", "X"), "k", "t", "u")


def test_asof_deals_a_hot_key_to_many_windows(spark):
    t = F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, id)")
    l = spark.range(20_000).select(F.lit("hot").alias("k"), t.alias("t"), "id")
    r = spark.range(0, 20_000, 7).select(F.lit("hot").alias("k"), t.alias("t"), F.col("id").alias("v"))
    got = asof_join(l, r, ["k"], "t", blocks=40)
    assert got.filter("v <> id - id % 7 or v is null").isEmpty() and got.count() == 20_000


COLUMNS = "id long, name string, day date, at timestamp, price double, ok boolean"


def table(spark, n=1000):
    rows = [(i, None if i % 50 == 0 else f"n{i % 7}", DAY + dt.timedelta(i), dt.datetime(2024, 1, 1, 0, 0, i % 60), i / 3, i % 2 == 0) for i in range(n)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def endpoint(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pages") / "t")
    df = table(spark).repartitionByRange(3, "id")
    assert paged.write_pages(df, folder, rows=100) >= 10
    return folder


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_pages_hold_the_table(spark, endpoint):
    paged.register(spark)
    df = spark.read.format("paged_table").load(endpoint)
    assert df.schema == table(spark).schema and rows(df.na.fill("?")) == rows(table(spark).na.fill("?"))
    assert rows(spark.read.format("paged_table").option("columns", "price, id").load(endpoint)) == rows(table(spark).select("price", "id"))
    with pytest.raises(Exception, match="no such columns"):
        spark.read.format("paged_table").option("columns", "nothing").load(endpoint).count()


@pytest.mark.parametrize("where", ["id = 7", "id > 500 and name = 'n3'", "name in ('n1', 'n2') and price < 40.5", "name is null", "day <= date'2024-03-01' and ok", "not (id < 990)", "name = 'n1' or id = 3", "at > timestamp'2024-01-01 00:00:30'", "id in (1, 2, 5000)", "name like 'n4%'", "id > 100000"])
def test_filters_give_the_same_rows(spark, endpoint, where):
    paged.register(spark)
    got = spark.read.format("paged_table").load(endpoint).filter(where)
    assert rows(got.na.fill("?")) == rows(table(spark).filter(where).na.fill("?"))


def test_filters_reach_the_reader_and_leave_pages_out(spark, endpoint):
    index = json.loads(paged.fetch(endpoint, "index.json"))
    source = paged.PagedTable({"path": endpoint})
    reader = source.reader(source.schema())
    filters = [EqualTo(("name",), "n3"), GreaterThan(("id",), 850), LessThanOrEqual(("price",), 300.0), In(("id",), (855, 901)), IsNotNull(("day",))]
    assert list(reader.pushFilters(filters)) == [filters[2]]  # floating point stays with Spark
    pages = [c for p in reader.partitions() for c, _ in p.cursors]
    assert 0 < len(pages) <= 3 < len(index["pages"])
    got = [i for p in reader.partitions() for b in reader.read(p) for i in b.column(0).to_pylist()]
    assert got == [i for i in (855, 901) if i % 7 == 3 and i % 50]
    asked = paged.scan_pages(spark, endpoint, ["id"], {"name": ["n1", "n2"]}, ("day", "2024-02-01"))
    assert rows(asked) == rows(table(spark).filter("name in ('n1', 'n2') and day <= date'2024-02-01'").select("id"))


def test_pages_are_asked_for_again(spark, endpoint):
    """Over http: the first answer of each page fails or lacks rows."""
    asked = {}

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            name = self.path.rsplit("/", 1)[1]
            asked[name] = asked.get(name, 0) + 1
            body = paged.fetch(endpoint, name)
            if asked[name] == 1 and name != "index.json":
                if name.endswith("0.json"):
                    return self.send_error(503)
                body = json.dumps({"data": json.loads(body)["data"][1:]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        paged.register(spark)
        df = spark.read.format("paged_table").option("pause", "0.01").load(f"http://127.0.0.1:{server.server_port}/t")
        assert df.count() == 1000 and min(n for name, n in asked.items() if name != "index.json") == 2
        with pytest.raises(ValueError):
            paged.fetch_again(endpoint, "index.json", lambda a: False, 2, 0.0)
    finally:
        server.shutdown()


def test_an_empty_table_and_columns_without_values(spark, tmp_path):
    empty, nulls = str(tmp_path / "e"), str(tmp_path / "n")
    assert paged.write_pages(table(spark).limit(0), empty) == 0 and paged.write_pages(spark.createDataFrame([(None, 1)], "a string, b int"), nulls) == 1
    assert paged.scan_pages(spark, empty).count() == 0
    assert paged.scan_pages(spark, nulls, where={"a": "x"}).count() == 0 and rows(paged.scan_pages(spark, nulls)) == [(None, 1)]
