"""Streams whose rounds are cut by micro-batches, with late rows and restarts, against the static operators."""

import json
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tapeline.sources import domain as D
from tapeline.streaming import keyed as K
from tapeline.streaming import realtime as X

FOLDER = "/root/testdata/sf0.001"
LEAST = 0.06


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    names = ("spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[1], "2")  # each partition of each operator has a store of its own
    yield
    for n, v in zip(names, before, strict=True):
        spark.conf.set(n, v)


def files(spark, df, folder, parts, order, first=0):
    """df as `parts` files that a stream reads one by one: cut anywhere, neighbours a little out of order."""
    rows = df.orderBy(order).collect()
    rng = random.Random(1)
    size = -(-len(rows) // parts)
    keyed = sorted(range(len(rows)), key=lambda i: i + rng.randrange(0, 12))
    for k in range(parts):
        own = [rows[i] for i in keyed[k * size : (k + 1) * size]]
        spark.createDataFrame(own, df.schema).coalesce(1).write.mode("append").parquet(f"{folder}/{first + k:03d}")


def source(spark, df, folder):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def run(df, handle, folder, name=None):
    writer = df.writeStream.foreachBatch(handle).option("checkpointLocation", folder).trigger(availableNow=True)
    query = (writer.queryName(name) if name else writer).outputMode("append").start()
    assert query.awaitTermination(300)
    assert query.exception() is None
    return query


def test_rounds_cut_by_batches_equal_static_ones(spark, tmp_path):
    """Ranks, points and events over all rounds; a restart in between; a late quote is left and counted."""
    quotes = D.quotes(spark, FOLDER).select("stock_code", F.col("quote_time").cast("timestamp").alias("quote_time"), "last_price", "change_pct", "amount_yuan", "limit_up", "limit_down")
    quotes = spark.createDataFrame(quotes.orderBy("quote_time").limit(420).collect(), quotes.schema)
    active = quotes.select("stock_code").distinct()
    n = F.col("stock_code").cast("int")
    groups = active.select(F.explode(F.array(F.struct(F.lit("concept").alias("sector_type"), F.concat(F.lit("G"), n % 7).alias("sector_code")), F.struct(F.lit("industry").alias("sector_type"), F.concat(F.lit("I"), n % 3).alias("sector_code")))).alias("_"), "stock_code").select("_.*", "stock_code")
    last = quotes.agg(F.max("quote_time")).first()[0]
    half = quotes.agg(F.percentile_approx("quote_time", 0.5)).first()[0]
    files(spark, quotes.filter(F.col("quote_time") <= half), str(tmp_path / "in"), 4, "quote_time")

    listener = K.Lateness()
    spark.streams.addListener(listener)
    stream = lambda: K.report(source(spark, quotes, str(tmp_path / "in")), groups, active, LEAST, jump=2, every="1 hour", delay="12 hours")
    handle = K.write_report(str(tmp_path / "out"))
    run(stream(), handle, str(tmp_path / "state"), "rounds")
    files(spark, quotes.filter(F.col("quote_time") > half), str(tmp_path / "in"), 4, "quote_time", 4)
    # A quote a week late, and one far ahead that closes all rounds.
    odd = [("000001", last - timedelta(days=7), 1.0, 99.0, 1.0, 2.0, 0.5), ("x", last + timedelta(days=9), 1.0, 0.0, 1.0, 2.0, 0.5)]
    spark.createDataFrame(odd[1:], quotes.schema).coalesce(1).write.parquet(str(tmp_path / "in/100"))
    run(stream(), handle, str(tmp_path / "state"), "rounds")
    spark.createDataFrame(odd[:1], quotes.schema).coalesce(1).write.parquet(str(tmp_path / "in/101"))
    run(stream(), handle, str(tmp_path / "state"), "rounds")
    for _ in range(50):
        if listener.counts.get("rounds", {}).get("dropped"):
            break
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    assert listener.counts["rounds"]["dropped"] == 1

    static = K.rounds(quotes, "1 hour")
    rounds = X.points(X.accepted(static, active, LEAST))
    ranks = X.ranked(X.strength(static, groups, "sector_code", "sector_type"), rounds, "sector_code", "sector_type")
    line = X.timeline(static, active, LEAST)
    read = lambda kind: spark.read.parquet(str(tmp_path / "out" / kind))
    as_rows = lambda df, *columns: sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    point = ("trade_date", "point", "round_time", "quotes", "up", "down", "state")
    got = as_rows(read("point"), *point)
    assert got == as_rows(line, *point) and len(got) > 25
    rank = ("round_time", "sector_type", "sector_code", "rank", "previous_rank", "rank_change", "leader")
    assert as_rows(read("rank"), *rank) == as_rows(ranks, *rank)
    event = ("round_time", "event", "sector_code", "rank", "previous_rank", "value")
    want = [X.change_events(ranks.filter(F.col("sector_type") == t), line.filter("point = 1") if t == "industry" else line, "sector_code", 2) for t in ("concept", "industry")]
    want = want[0].unionByName(want[1]).withColumnRenamed("kind", "event")
    got = as_rows(read("event"), *event)
    assert got == as_rows(want, *event) and {r[1] for r in got} == {"market_breadth_changed", "rank_up", "rank_down", "leader_changed"}
    ids = [r.event_id for r in read("event").collect()]
    assert len(ids) == len(set(ids))


def test_a_full_round_in_two_batches_is_published(spark, tmp_path):
    t = datetime(2024, 1, 2, 10)
    rows = [(f"{i:06d}", t + timedelta(seconds=i), 10.0, float(i), 1.0, 11.0, 9.0) for i in range(40)]
    schema = "stock_code string, quote_time timestamp, last_price double, change_pct double, amount_yuan double, limit_up double, limit_down double"
    quotes = spark.createDataFrame(rows, schema)
    for k, part in enumerate((rows[:20], rows[20:], [("x", t + timedelta(hours=2), 1.0, 0.0, 1.0, 2.0, 0.5)])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    active = quotes.select("stock_code")
    stream = K.rounds(source(spark, quotes, str(tmp_path / "in")))
    run(stream, X.publish(str(tmp_path / "out"), "overview", X.overview, active), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out/overview")).filter("quotes > 1").collect()
    assert [(r.round_time, r.quotes, r.up) for r in got] == [(t, 40, 39)]


def test_last_depths_keep_a_list_by_stock(spark, tmp_path):
    t = datetime(2024, 1, 2, 10)
    side = lambda p: [(1, p, 100), (2, p + 0.1, 50)]
    rows = [(f"{i % 3:06d}", t + timedelta(seconds=i), side(9.0 + i / 100), side(10.0 + i / 100)) for i in range(30)]
    schema = "stock_code string, depth_time timestamp, bids array<struct<level:int,price:double,volume:long>>, asks array<struct<level:int,price:double,volume:long>>"
    depth = spark.createDataFrame(rows, schema)
    files(spark, depth, str(tmp_path / "in"), 5, "depth_time")
    batches = {}
    query = K.last_depths(source(spark, depth, str(tmp_path / "in"))).writeStream.foreachBatch(lambda b, i: batches.update({i: b.collect()})).outputMode("update").option("checkpointLocation", str(tmp_path / "s")).start()
    for _ in range(300):
        if query.exception() or sum(p.numInputRows for p in query.recentProgress) >= 30:
            break
        time.sleep(0.2)
    query.stop()
    final = {}
    for i in sorted(batches):
        for code in {r.stock_code for r in batches[i]}:
            final[code] = [(r.depth_time, json.loads(r.features)["bid_volume"]) for r in sorted(batches[i], key=lambda r: r.place) if r.stock_code == code]
    want = {}
    for r in X.last_depths(X.depth_features(depth)).orderBy(F.desc("depth_time")).collect():
        want.setdefault(r.stock_code, []).append((r.depth_time, r.bid_volume))
    assert final == want and all(len(v) == 3 for v in final.values())


def test_minute_ring_equals_the_whole_day(spark, tmp_path):
    minutes = D.minutes(spark, FOLDER).withColumn("bar_time", F.col("bar_time").cast("timestamp"))
    some = minutes.select("trade_date").distinct().orderBy("trade_date").limit(3)
    minutes = spark.createDataFrame(minutes.join(some, "trade_date").select(minutes.columns).collect(), minutes.schema)
    files(spark, minutes, str(tmp_path / "in"), 4, "bar_time")
    final = {}

    def keep(batch, _):
        final.update({(r.stock_code, r.trade_date): tuple(None if x is None else round(x, 6) for x in r[2:]) for r in batch.collect()})

    query = K.minute_features(source(spark, minutes, str(tmp_path / "in"))).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    assert query.awaitTermination(200)
    names = [x.split()[0] for x in K.MINUTES.split(", ")][2:]
    want = {(r.stock_code, r.trade_date): tuple(None if r[c] is None else round(r[c], 6) for c in names) for r in X.minute_features(minutes).collect()}
    assert final == want and len(want) > 10


def test_entries_trigger_reject_or_expire(spark, tmp_path):
    t = datetime(2024, 1, 2, 9, 30)
    at = lambda s: t + timedelta(seconds=s)
    candidates = [("1", "open", at(0), at(60)), ("2", "open", at(0), at(60)), ("3", "auction", at(0), at(60)), ("4", "open", at(0), at(60)), ("5", "auction", at(0), at(60)), ("6", "open", at(0), at(60)), ("7", "intraday", at(0), at(300))]
    quotes = [("1", at(10), 10.0, 11.0), ("2", at(10), 10.0, 11.0), *[("3", at(5 * k), 10.0, 11.0) for k in range(1, 5)], ("4", at(50), 10.0, 11.0), ("5", at(10), 10.0, 11.0), ("7", at(30), 10.0, 11.0), *[("7", at(60 * k), 10.0, 11.0) for k in range(1, 5)], ("z", at(4000), 1.0, 1.0)]
    price = {"1": 10.1, "2": 10.6, "3": 10.1, "4": 10.1, "5": 10.1, "7": 10.2, "z": 1.0}
    ask = lambda p: [(1, p, 100)]
    depths = [(c, q - timedelta(seconds=2), ask(price[c])) for c, q, *_ in quotes if c != "4"] + [("4", at(5), ask(10.1))]
    q = spark.createDataFrame(quotes, "stock_code string, quote_time timestamp, pre_close_price double, limit_up double")
    d = spark.createDataFrame(depths, "stock_code string, depth_time timestamp, asks array<struct<level:int,price:double,volume:long>>")
    files(spark, q, str(tmp_path / "q"), 3, "quote_time")
    files(spark, d, str(tmp_path / "d"), 3, "depth_time")
    found = []
    c = spark.createDataFrame(candidates, "stock_code string, entry_mode string, starts timestamp, ends timestamp")
    run(K.entries(c, source(spark, q, str(tmp_path / "q")), source(spark, d, str(tmp_path / "d"))), lambda b, _: found.extend(b.collect()), str(tmp_path / "s"))
    got = {r.stock_code: (r.decision, r.reason) for r in found}
    assert len(found) == len(got)
    assert got == {
        "1": ("trigger", "entry_confirmation_matched"), "2": ("reject", "gap_above_range"), "3": ("trigger", "entry_confirmation_matched"), "4": ("expired", "no_quote"),
        "5": ("expired", "auction_depth_history_insufficient"), "6": ("expired", "no_quote"), "7": ("trigger", "entry_confirmation_matched"),
    }


def test_stale_rows_are_counted(spark, tmp_path):
    t = datetime(2024, 1, 2, 10)
    df = spark.createDataFrame([(i, t, t + timedelta(seconds=10 * i)) for i in range(10)], "k long, quote_time timestamp, arrival_time timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in/0"))
    listener, rows = K.Lateness(), []
    spark.streams.addListener(listener)
    run(K.watched(source(spark, df, str(tmp_path / "in")), "age", 45), lambda b, _: rows.extend(b.collect()), str(tmp_path / "s"), "fresh")
    for _ in range(50):
        if listener.counts.get("fresh", {}).get("seen"):
            break
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    assert (listener.counts["fresh"]["seen"], listener.counts["fresh"]["stale"], len(rows)) == (10, 5, 5)
