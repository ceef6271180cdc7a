"""The simulation queries against their SQL, on events with prices of nought."""

import math

import pytest

from tallyfin.plans import market

duckdb = pytest.importorskip("duckdb")

#: Fourteen hours of three prices each; a nought in the last hours, or as the close of the second, leaves the last value of volatility to an earlier hour or the mean log return infinite.
HOURS = {
    "plain": [(20.0 + h, 26.0 + h, 23.0 + (7 * h) % 5) for h in range(14)],
    "late": [(20.0, 0.0, 23.0) if h == 11 else (20.0 + h, 31.0 - h, 25.0) for h in range(14)],
    "fallen": [(20.0, 22.0, 0.0) if h == 1 else (20.0 + h, 31.0, 25.0 - h) for h in range(14)],
    "short": [(20.0, 22.0, 21.0)] * 5,
    "still": [(20.0, 20.0, 20.0)] * 14,
}


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("events")
    rows = [(t, h, v) for t, hours in HOURS.items() for h, values in enumerate(hours) for v in values]
    values = ", ".join(f"({i}, timestamp '2024-01-01' + interval {h} hour + interval {i % 3} minute, '{t}', {v!r}::double)" for i, (t, h, v) in enumerate(rows))
    duckdb.sql(f"copy (select * from (values {values}) e(event_id, ts, event_type, value)) to '{folder}/events.parquet'")
    return str(folder)


def told(rows):
    return sorted((tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows), key=repr)


def matched(spark, sf_dir, name):
    """The rows of a query, by ticker, once they are those of its SQL."""
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{sf_dir}/events.parquet'")
    got = told(tuple(r) for r in market.QUERIES[name](spark, sf_dir).collect())
    assert got == told(con.execute(market.ORACLES[name]).fetchall())
    return {t: [r for r in got if r[0] == t] for t in HOURS}


def test_parameters_take_the_last_known_volatility(spark, sf_dir):
    got = {t: r for t, (r,) in matched(spark, sf_dir, "q_gbm_params").items()}
    assert got["late"][3] > 0 and math.isfinite(got["late"][2])
    assert got["fallen"][2] == -math.inf and got["fallen"][3] > 0
    assert got["short"][2:] == (None, None, None)


def test_paths_of_the_last_known_volatility(spark, sf_dir):
    got = matched(spark, sf_dir, "q_gbm_paths")
    assert len(got["late"]) == market.GBM_PATHS * 13 and all(r[3] >= 0 for r in got["late"])
    assert {r[3] for r in got["fallen"]} == {"nan", 0.0} and {r[3] for r in got["short"]} == {None}


def test_mean_path_of_the_last_known_volatility(spark, sf_dir):
    got = matched(spark, sf_dir, "q_gbm_mean_path")
    assert [r[1] for r in sorted(got["late"])] == list(range(13)) and all(r[2] > 0 for r in got["late"])
    assert sorted(got["fallen"]) == [("fallen", 0, "nan"), *(("fallen", k, 0.0) for k in range(1, 13))]


def test_final_statistics_of_the_last_known_volatility(spark, sf_dir):
    got = matched(spark, sf_dir, "q_gbm_final_stats")
    ((_, mean, median, std, low, high),) = got["late"]
    assert mean > 0 and std > 0 and low < median < high
    assert got["fallen"] == [("fallen", 0.0, 0.0, 0.0, 0.0, 0.0)] and got["short"] == [("short", *[None] * 5)]


def test_histogram_of_the_last_known_volatility(spark, sf_dir):
    got = matched(spark, sf_dir, "q_mc_histogram")
    assert len(got["late"]) > 1 and sum(r[4] for r in got["late"]) == market.GBM_PATHS
    assert got["fallen"] == [("fallen", 19, 0.0, 0.0, market.GBM_PATHS)] and got["short"] == [("short", 19, None, None, market.GBM_PATHS)]
    ((_, at, low, high, n),) = got["still"]
    assert at == 19 and low == high and n == market.GBM_PATHS


@pytest.fixture(scope="module")
def untyped_dir(tmp_path_factory, sf_dir):
    """The same events, where the plain ones have no type."""
    folder = tmp_path_factory.mktemp("untyped")
    duckdb.sql(f"copy (select * replace (nullif(event_type, 'plain') as event_type) from '{sf_dir}/events.parquet') to '{folder}/events.parquet'")
    return str(folder)


def test_paths_without_a_type_are_null(spark, untyped_dir):
    matched(spark, untyped_dir, "q_gbm_paths")


def test_final_statistics_keep_a_null_type(spark, untyped_dir):
    matched(spark, untyped_dir, "q_gbm_final_stats")


def test_mean_path_without_a_type_is_null(spark, untyped_dir):
    matched(spark, untyped_dir, "q_gbm_mean_path")


ODD = {
    "hour without a time": "case when hour(ts) = 2 then null else ts end as ts",
    "ends without a value": "case when hour(ts) in (3, 13) and minute(ts) <> 1 then null else value end as value",
    "events of one number": "event_id // 2 as event_id",
}


@pytest.mark.parametrize("odd", ODD)
def test_mean_path_of_odd_events(spark, sf_dir, tmp_path, odd):
    duckdb.sql(f"copy (select * replace ({ODD[odd]}) from '{sf_dir}/events.parquet') to '{tmp_path}/events.parquet'")
    assert all(r[2] > 0 for r in matched(spark, str(tmp_path), "q_gbm_mean_path")["plain"])
