import datetime as dt

from tallyfin.streaming import bars


def _run(df, mode, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_streams(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, i // 4, 15 * (i % 4)), i % 2, "click", 1.0 + i, "{}") for i in range(12)]
    spark.createDataFrame(rows, bars.EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    events = bars.read_events(spark, str(tmp_path / "in"), "*.parquet")
    got = {r.start.hour: r for r in _run(bars.window_bars(events), "complete", "bars").collect()}
    assert got[1].open == 5.0 and got[1].close == 8.0 and got[1].volume == 4
    ew = _run(bars.running_volatility(events), "update", "ewma").collect()
    assert ew[-1].n == 12 and ew[-1].value == 12.0 and ew[-1].variance > 0
    assert sum(r.n for r in _run(bars.sessions(events, "40 minutes"), "complete", "sess").collect()) == 12
