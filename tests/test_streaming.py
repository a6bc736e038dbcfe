"""Stream wrappers: batches equal the static operator; keyed state sells once."""

from datetime import datetime, timedelta

from tapeline.sources import domain as D
from tapeline.streaming import realtime as X

FOLDER = "/root/testdata/sf0.001"


def test_published_rounds_equal_the_static_round(spark, tmp_path):
    quotes = D.quotes(spark, FOLDER)
    quotes.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(quotes.schema).parquet(str(tmp_path / "in"))
    X.run_rounds(stream, X.publish(str(tmp_path / "out"), "overview", X.overview), str(tmp_path / "state")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out/overview")).drop("batch")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, X.overview(quotes).collect()))


def test_exit_triggers_keep_state(spark, tmp_path):
    t = datetime(2024, 1, 2, 10)
    # Trade, days held, price; 4 has no bid and an old depth at first, 5 is of a trade that ended long ago, 6 sells its last lot by legs.
    path = [(1, 0, 90.0), (1, 1, 104.0), (1, 1, 105.5), (1, 1, 111.0), (1, 1, 50.0), (2, 1, 95.0), (3, 3, 100.5), (4, 1, 90.0), (4, 1, 90.0), (4, 1, 91.0), (5, 30, 90.0), (6, 1, 107.0), (6, 1, 103.5), (6, 2, 90.0)]
    rows = []
    for i, (k, d, p) in enumerate(path):
        at = t + timedelta(minutes=i)
        rows.append((k, at, at - timedelta(seconds=3), at - timedelta(seconds=60 if i == 8 else 5), p, None if i == 7 else p - 0.1, 100.0, 100 if k == 6 else 300, d))
    df = spark.createDataFrame(rows, "trade_id long, poll_time timestamp, quote_time timestamp, depth_time timestamp, last_price double, bid double, entry_price double, quantity long, holding_days int")
    df.repartition(1).write.parquet(str(tmp_path / "q"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "q"))
    query = X.exit_triggers(stream).writeStream.format("memory").queryName("exits").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    rows = lambda x: sorted((r.trade_id, r.trigger, r.price, r.quantity, r.remaining) for r in x.collect())
    got = rows(spark.table("exits"))
    assert got == rows(X.exit_triggers(df)) == [(1, "take_profit_1", 105.4, 100, 200), (1, "take_profit_2", 110.9, 200, 0), (2, "hard_stop", 94.9, 300, 0), (3, "time_exit", 100.4, 300, 0), (4, "hard_stop", 90.9, 300, 0), (6, "take_profit_1", 106.9, 100, 0)]
