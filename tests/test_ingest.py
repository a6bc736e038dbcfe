"""Normalisers' own results feed the operators behind them; fields that a feed lacks are null; triggers against a plain loop."""

import pytest
from pyspark.sql import functions as F

from tapeline.functions import windows as W
from tapeline.operators import factors, ingest, insight, merge


@pytest.fixture(scope="module")
def daily(spark):
    rows = [("600001.SH", f"202401{d:02d}", str(10 + d), str(11 + d), str(9 + d), str(10.5 + d), str(9.5 + d), "100", "2000") for d in range(2, 13)]
    return ingest.normalize_daily(spark.createDataFrame(rows, "ts_code string, trade_date string, open string, high string, low string, close string, pre_close string, vol string, amount string"))


def test_flow_and_bars_feed_fund_factors(spark, daily):
    names = ["net_mf_amount", *[f"{side}_{k}_amount" for k in ("sm", "md", "lg", "elg") for side in ("buy", "sell")]]
    rows = [("600001.SH", f"202401{d:02d}", "30", "1", "2", "3", "4", "50", "20", None if d == 5 else "9", "1") for d in range(2, 13)]
    flow = ingest.normalize_moneyflow(spark.createDataFrame(rows, "ts_code string, trade_date string, " + ", ".join(f"{n} string" for n in names)))
    r = {x.trade_date.day: x for x in flow.collect()}
    assert (r[2].main_net_inflow, r[2].big_order_net_inflow, r[2].super_large_net_inflow, r[2].small_net_inflow, r[2].large_buy_amount) == (300000.0, 300000.0, 80000.0, -10000.0, 500000.0)
    assert r[5].super_large_net_inflow is None and r[5].super_large_sell_amount == 10000.0
    assert factors.fund_factors(flow, daily).count() == len(rows)


def test_events_feed_ladder_and_one_word(spark, daily):
    rows = [("600001.SH", "20240102", "U", None, None, "", "0", "12", "93005", "14:56:01"), ("600001.SH", "20240103", " ", "u", None, "2", "7", "13.5", "09:30", "x"), ("600001.SH", "20240104", None, None, "1/1", None, None, "9", "250000", None)]
    raw = spark.createDataFrame(rows, "ts_code string, trade_date string, limit string, limit_type string, up_stat string, open_times string, open_count string, limit_price string, first_time string, last_time string")
    events = ingest.normalize_limit_events(raw)
    got = [(r.event_type, r.open_count, r.limit_price, r.first_time, r.last_time, r.close_price) for r in events.orderBy("trade_date").collect()]
    assert got == [("limit_up", 0, 12.0, "09:30:05", "14:56:01", None), ("limit_up", 2, 13.5, "09:30:00", None, None), ("limit_up", None, 9.0, None, None, None)]
    locked = events.join(daily, ["stock_code", "trade_date"]).select(F.dayofmonth("trade_date").alias("d"), insight.one_word(F.col("limit_price"), F.col("open_price"), F.col("open_count")).alias("y"))
    assert {r.d: r.y for r in locked.collect()} == {2: True, 3: False, 4: False}
    days = daily.select("trade_date").distinct().withColumn("idx", F.dayofmonth("trade_date").cast("long"))
    boards = W.calendar_streak(events.select("stock_code", "trade_date"), days)
    assert sorted((r.trade_date.day, r.board_count) for r in insight.limit_ladder(events, boards).collect()) == [(2, 1), (3, 2), (4, 3)]
    assert events.unionByName(ingest.normalize_suspensions(raw)).count() == 6


def test_topics_and_upserts_take_the_last(spark):
    raw = spark.createDataFrame([("1.SZ", "20240331", "9", "1", 1), ("1.SZ", "20240331", "5", "1", 2)], "ts_code string, end_date string, revenue string, n_income string, sent int")
    assert [r.revenue for r in ingest.normalize_topic(raw, "income", "sent").collect()] == [5.0]
    old = spark.createDataFrame([(1, 0, "a"), (2, 0, "b")], "k int, sent int, v string")
    new = spark.createDataFrame([(2, 1, "c"), (2, 2, "d"), (3, 1, "e")], "k int, sent int, v string")
    assert sorted((r.k, r.v) for r in merge.upsert(old, new, ["k"], [F.desc("sent")]).collect()) == [(1, "a"), (2, "d"), (3, "e")]


def test_bounded_windows_pass_nulls_over(spark):
    values = [1.0, None, 2.0, 2.0, None, None, 3.0, 8.0]
    df = spark.createDataFrame(list(enumerate(values)), "trade_date int, v double").withColumn("k", F.lit("a"))
    got = [(r.sample, r.percentile) for r in W.history_percentile(df, ["k"], "trade_date", "v", 3).orderBy("trade_date").collect()]
    expected, ratios = [], []
    for i, v in enumerate(values):
        known = [x for x in values[:i] if x is not None][-3:]
        place = None if v is None or not known else (sum(x < v for x in known) + sum(x == v for x in known) / 2) / len(known) * 100
        expected.append((len(known), place))
        ratios.append(None if v is None or len(known) < 2 else v / (sum(known) / len(known)))
    assert got == expected
    assert [r.o for r in W.baseline_ratio(df, "v", 3, 2, "o", keys=("k",)).orderBy("trade_date").collect()] == ratios


def test_exits_of_a_static_frame_equal_a_loop(spark):
    from tapeline.plans.realtime_queries import QUERIES, held

    folder = "/root/testdata/sf0.001"
    expected = []
    state = {}
    for q in sorted(held(spark, folder).collect(), key=lambda r: (r.trade_id, r.poll_time, r.last_price)):
        top, taken, left = state.get(q.trade_id, (0.0, 0, q.quantity))
        if not left or not q.holding_days or q.bid is None or (q.trade_id not in state and q.holding_days > 10):
            continue
        top = max(top, q.entry_price, q.last_price)
        now, high, fall = (q.last_price / q.entry_price - 1) * 100, (top / q.entry_price - 1) * 100, (top - q.last_price) / top * 100
        found = [n for n, yes in (("hard_stop", now <= -4), ("trailing_stop", high >= 6 and fall >= 3), (f"take_profit_{taken + 1}", taken < 2 and now >= (5, 10, 0)[taken]), ("time_exit", q.holding_days >= 3)) if yes][:1]
        for name in found:
            leg = name.startswith("take")
            sold = (left // 2 // 100 * 100 or left) if leg and not taken else left
            taken, left = taken + leg, left - sold
            expected.append((q.trade_id, q.quote_time, name, q.bid, sold, left))
        state[q.trade_id] = (top, taken, left)
    got = sorted(map(tuple, QUERIES["x18_exit_triggers"](spark, folder).collect()))
    assert got == sorted(expected) and len(expected) > 10 and {r[2][:4] for r in got} >= {"hard", "take"}
