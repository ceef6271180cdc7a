import pytest

from tallyfin.schema import MissingColumns, canonical_name, validate_columns
from tallyfin.sources.prices import read_price_files

A = "﻿Date,Open,High,Low,Close ,Adj Close ,Volume\n3-Oct-24,23,24,22,23.5,23.5,\"1,000\"\n2-Oct-24,1.66 Dividend,,,,,\n1-Oct-24,22,23,21,22.5,22.5,\"2,500\"\n"
B = "Date,Open,High,Low,Close,Adj Close,Volume\n2023-08-17,10,11,9,10,10,5\n2023-08-18,10,12,9,11,11,-\n"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("prices")
    (d / "AAA.csv").write_text(A, encoding="utf-8")
    (d / "BBB.csv").write_text(B, encoding="utf-8")
    wide = ",".join(f"X{k}" for k in range(20))
    (d / "WIDE.csv").write_text(f"Date,{wide},Open,High,Low,Close,Adj Close,Volume\n2023-08-17,{','.join('0' * 20)},10,11,9,10,10,5\n", encoding="utf-8")
    (d / "BAD.csv").write_text("Date,Price\n2023-08-17,1\n", encoding="utf-8")
    return [x.cache() for x in read_price_files(spark, f"{d}/*.csv")]


def test_prices(files):
    rows = {(r.ticker, str(r.date)): r for r in files[0].collect()}
    assert set(rows) == {("AAA", "2024-10-03"), ("AAA", "2024-10-01"), ("BBB", "2023-08-17"), ("BBB", "2023-08-18"), ("WIDE", "2023-08-17")} and rows["WIDE", "2023-08-17"].volume == 5
    assert rows["AAA", "2024-10-03"].volume == 1000 and rows["BBB", "2023-08-18"].volume is None
    assert rows["AAA", "2024-10-01"].close == 22.5


def test_dividends_and_rejects(files):
    assert [(r.ticker, str(r.date), r.amount) for r in files[1].collect()] == [("AAA", "2024-10-02", 1.66)]
    assert [(r.ticker, "adj_close" in r.missing) for r in files[2].collect()] == [("BAD", True)]


def test_columns(spark):
    assert canonical_name("﻿Adj Close ") == "adj_close"
    with pytest.raises(MissingColumns):
        validate_columns(spark.range(1), ["id", "close"])
