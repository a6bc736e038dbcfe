"""Registered queries against their SQL twins on the smallest tables; all of them run on larger ones outside the tests."""

import decimal
import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tapeline.plans import registry

FOLDER = "/root/testdata/sf0.001"
NAMES = ["f01_daily_factors", "f05_daily_factors_v2", "f08_minute_factors", "a06_concept_metrics", "m09_concept_heat", "r05_ma_golden_cross", "r18_signal_outcomes", "c01_daily_bars", "c20_upsert", "c24_sync_membership", "p02_canonical_rows", "q01_coverage", "q02_gaps", "q05_asset_summary", "q07_readiness", "q06_daily_health", "j05_date_universe", "j14_latest_state", "f10_backfill_window", "a16_series", "r23_rank_trials", "x03_above_ma", "x05_limit_hits", "x06_sector_strength", "x07_pool_summary", "x09_timeline", "x17_entry_triggers", "x20_fresh_quotes", "x02_overview", "x08_rank_delta", "x10_change_events", "x11_changed_quotes", "x15_merge_targets", "x16_opening_depth", "r17_reconcile", "w17_calendar_streak", "c02_daily_basic", "c03_moneyflow", "c05_limit_events", "c06_suspensions", "c07_index_daily", "c09_sector_bar", "c11_dragon_tiger", "c14_topics", "c21_insert_only", "c34_published", "p01_eligible", "p12_trend_history", "p17_stock_overview", "p17_stock_series", "p17_stock_session", "p17_stock_events", "q08_unit_samples", "j09_kth_open_after", "w15_history_percentile", "w22_baseline_ratio"]


def plain(v):
    return repr(float(v) + 0.0) if isinstance(v, (float, decimal.Decimal)) else str(v)


def test_every_query_has_sql():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"x18_exit_triggers"} and set(registry.ORACLES) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = con.sql(registry.ORACLES[name])
    assert sorted(rel.columns) == columns
    places = [rel.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in places) for r in rel.fetchall())


def test_readiness_by_kinds_of_blocks(spark):
    """Core blocks are measured by the day's bars; enhancements degrade, optional ones don't."""
    from tapeline.operators import quality as A

    fine = {"active": 5000, "indexes": 7, "sectors": 400, "bars": 4800, "basic": 4600, "flow": 4600, "adjust": 4800, "index": 6, "technical": 4600, "events_captured": True, "sector_bars": 360, "sector_flow": 90, "sector_flow_captured": True, "market_stats": 3}
    cases = {
        1: ({}, "complete", ""), 2: ({"basic": 4320}, "blocked", "basic"), 3: ({"bars": 4700, "basic": 4500, "flow": 4500, "adjust": 4500}, "blocked", "bars"), 4: ({"index": 5}, "blocked", "index"), 5: ({"technical": 4500}, "degraded", "technical"),
        6: ({"events_captured": False}, "degraded", "events"), 7: ({"sector_bars": 359, "adjust": None}, "blocked", "adjust,sector_bars"), 8: ({"sector_flow_captured": None}, "degraded", "sector_flow"), 9: ({"market_stats": 0}, "complete", "market_stats"),
    }
    df = spark.createDataFrame([(k, *(fine | change).values()) for k, (change, *_) in cases.items()], "trade_date long, " + ", ".join(f"{c} {'boolean' if v is True else 'long'}" for c, v in fine.items()))
    assert {r.trade_date: (r.status, r.missing) for r in A.readiness(df).collect()} == {k: tuple(v[1:]) for k, v in cases.items()}


def test_assets_are_judged_by_their_lag_and_by_active_stocks(spark):
    from datetime import date

    from tapeline.operators import quality as A

    days = [date(2024, 1, i) for i in (2, 3)]
    stocks = spark.createDataFrame([(f"{i}", "active" if i < 4 else "suspended") for i in range(6)], "stock_code string, status string")
    rows = lambda *pairs: spark.createDataFrame([(c, d) for c, d in pairs], "stock_code string, trade_date date")
    assets = {"a": rows(*[(f"{i}", d) for i in range(4) for d in days]), "b": rows(*[(f"{i}", days[1]) for i in range(3)]), "c": rows(*[(f"{i}", days[0]) for i in range(5)]), "d": rows(*[(f"{i}", days[0]) for i in range(4)])}
    dates = spark.createDataFrame([(d,) for d in days], "trade_date date")
    off = rows(("3", days[0]), ("5", days[1]))
    cover = A.coverage(assets, dates, stocks, off)
    assert {(r.asset, r.trade_date.day): (r.expected, r.actual, r.suspended, r.missing) for r in cover.collect() if r.asset in "bc"} == {("b", 2): (4, 0, 1, 3), ("b", 3): (4, 3, 0, 1), ("c", 2): (4, 4, 0, 0), ("c", 3): (4, 0, 0, 4)}
    stats = A.table_stats(assets)
    got = A.asset_summary(stats, A.stale_days(stats, dates), cover, {"d": 1})
    assert {r.asset: r.status for r in got.collect()} == {"a": "ok", "b": "partial", "c": "stale", "d": "ok"}


def test_only_open_candidates_are_refreshed_or_cancelled(spark):
    from tapeline.operators import strategy as S

    old = spark.createDataFrame([(1, "watching"), (2, "pending_confirmation"), (3, "entered"), (4, "rejected"), (5, "watching")], "k long, status string")
    new = spark.createDataFrame([(1,), (3,), (6,)], "k long")
    assert {r.k: (r.status, r.action) for r in S.reconcile_candidates(old, new, ["k"]).collect()} == {1: ("watching", "refreshed"), 2: ("cancelled", "cancelled"), 3: ("entered", "kept"), 4: ("rejected", "kept"), 5: ("cancelled", "cancelled"), 6: ("pending_confirmation", "created")}


def test_what_followed_four_days_the_third_of_which_is_pending(spark):
    """A day without scores gives no sample; the third day ahead counts compounded."""
    from tapeline.operators import insight as I

    scores = spark.createDataFrame([(1, 80.0, 20.0), (2, 30.0, None), (4, 55.0, 50.0)], "trade_date long, short_score double, risk_score double")
    raw = spark.createDataFrame([(1, 50.0, 0.5), (2, 66.0, 1.0), (3, 42.0, -1.0), (4, 58.0, 2.0)], "trade_date long, up_ratio_pct double, core_index_trend double")
    got = {(r.score, r.horizon, r.bucket): r for r in I.forward_validation(scores, raw).collect()}
    assert {k: r["sample"] for k, r in got.items() if k[0] == "short"} == {("short", 1, "high"): 1, ("short", 1, "low"): 1, ("short", 1, "all"): 2, ("short", 3, "high"): 1, ("short", 3, "all"): 1}
    high, all_ = got["short", 1, "high"], got["short", 1, "all"]
    assert (high.mean_breadth, high.mean_core, high.breadth_above_50, high.relationship) == (66.0, 1.0, 100.0, None)
    assert (all_.breadth_difference, all_.core_difference, all_.relationship, all_.rho_breadth) == (24.0, 2.0, "insufficient_samples", None)
    assert got["short", 3, "high"].mean_core == round((1.01 * 0.99 * 1.02 - 1) * 100, 4)
    assert got["risk", 1, "low"].mean_breadth == 66.0
    many = spark.createDataFrame([(i, 20.0 + 60 * (i % 2), None) for i in range(40)], "trade_date long, short_score double, risk_score double")
    path = spark.createDataFrame([(i, 40.0 + 20 * (i % 2 == 0), 0.0) for i in range(44)], "trade_date long, up_ratio_pct double, core_index_trend double")
    one = {r.horizon: r for r in I.forward_validation(many, path).collect() if r.bucket == "all"}
    assert one[1].relationship == "positive" and one[1].rho_breadth == 1.0 and one[1].breadth_difference == 20.0


def test_trials_by_the_rules_of_both_splits(spark):
    """Trades, days, win rates, both means and drift decide; eligible ones come first, then by the test split's lower bound."""
    from tapeline.operators import strategy as S

    good = [("train", 300, 80, 55.0, 1.0), ("test", 120, 30, 56.0, 1.0)]
    cases = {0: good, 1: [("train", 299, 80, 55.0, 1.0), good[1]], 2: [good[0], ("test", 120, 29, 56.0, 1.0)], 3: [("train", 300, 80, 47.9, 1.0), ("test", 120, 30, 50.0, 1.0)], 4: [good[0], ("test", 120, 30, 49.9, 1.0)], 5: [("train", 300, 80, 55.0, 0.0), good[1]], 6: [good[0], ("test", 120, 30, 63.1, 1.0)], 7: [good[0], ("test", 200, 30, 60.0, 2.0)], 8: [good[0]]}
    rows = [(i, 0, *side, side[4], side[3] / 100 - 0.1) for i, sides in cases.items() for side in sides]
    df = spark.createDataFrame(rows, "trial long, changes long, split string, trades long, days long, win_rate double, mean_return double, median_return double, wilson double")
    got = {r.trial: (r.verdict, r.place) for r in S.rank_trials(df).collect()}
    assert {i: v for i, (v, _) in got.items()} == {0: "eligible", 1: "data_insufficient", 2: "data_insufficient", 3: "rejected", 4: "rejected", 5: "rejected", 6: "rejected", 7: "eligible", 8: "data_insufficient"}
    assert got[7][1] == 1 and got[0][1] == 2 and got[8][1] == 9
    with pytest.raises(ValueError):
        S.grid(spark, {f"p{i}": 0.0 for i in range(11)}, {f"p{i}": [1.0] for i in range(11)})


def test_heat_takes_limit_downs_off(spark):
    from tapeline.streaming import realtime as X

    quotes = spark.createDataFrame([("1", "r", 11.0, 10.0, 11.0, 9.0, 1e7), ("2", "r", 9.0, -10.0, 11.0, 9.0, 1e7), ("3", "r", 10.0, 0.0, 11.0, 9.0, 0.0)], "stock_code string, round_time string, last_price double, change_pct double, limit_up double, limit_down double, amount_yuan double")
    groups = quotes.selectExpr("stock_code", "'g' as g")
    r = X.strength(quotes, groups, "g").first()
    # 17.5 of the mean, 10 of breadth, 25 of limit-ups, 10 off for limit-downs, log10(2e7) - 6 of the amount.
    assert (r.limit_ups, r.limit_downs, r.up, r.down, r.flat) == (1, 1, 1, 1, 1) and r.heat == pytest.approx(17.5 + 10 + 25 - 10 + 1.30103, abs=1e-4)


def test_entries_need_fresh_depth_and_history(spark):
    import datetime

    from tapeline.streaming import realtime as X

    now = datetime.datetime(2024, 1, 10, 10, 0)
    at = lambda s: now - datetime.timedelta(seconds=s)
    names = ["ok", "old quote", "old depth", "no ask", "auction few", "minutes few", "low", "high", "near"]
    mode = {"auction few": "auction", "minutes few": "intraday"}
    ask = {"low": 9.7, "high": 10.5, "near": 10.399}
    quotes = spark.createDataFrame([(n, at(16 if n == "old quote" else 5), 10.0, 10.4 if n == "near" else 11.0) for n in names], "stock_code string, quote_time timestamp, pre_close_price double, limit_up double")
    depth = spark.createDataFrame([(n, at(21 if n == "old depth" else 5), [] if n == "no ask" else [(1, ask.get(n, 10.1), 100)]) for n in names], "stock_code string, depth_time timestamp, asks array<struct<level:int,price:double,volume:long>>")
    minutes = spark.createDataFrame([], "stock_code string, bar_time timestamp")
    candidates = spark.createDataFrame([(n, mode.get(n, "open")) for n in names], "stock_code string, entry_mode string")
    got = {r.stock_code: r.reason for r in X.entry_triggers(candidates, quotes, depth, minutes, "2024-01-10 10:00:00").collect()}
    assert got == {"ok": "entry_confirmation_matched", "old quote": "quote_stale_or_missing", "old depth": "depth_stale_or_missing", "no ask": "executable_ask_missing", "auction few": "auction_depth_history_insufficient", "minutes few": "minute_history_insufficient", "low": "gap_below_range", "high": "gap_above_range", "near": "near_limit_up_queue"}


def test_leaders_of_sectors_without_sorting_stocks_by_sectors(spark):
    """Against a loop: sectors of one stock to all, ties, missing changes and flows, spans that end, a sector that isn't hot."""
    from datetime import date

    from tapeline.operators import insight as I

    days, codes = [date(2024, 1, i) for i in (2, 3, 4)], [f"{i:06d}" for i in range(40)]
    bars = [(c, d, None if (i + d.day) % 11 == 0 else float((i * 7 + d.day) % 9)) for i, c in enumerate(codes) for d in days]
    ups = {(c, d) for i, c in enumerate(codes) for d in days if (i * d.day) % 13 == 1}
    flows = {(c, d): float((i * 3) % 5) for i, c in enumerate(codes) for d in days if i % 4}
    members = [(f"s{k}", c, None, days[1] if i % 3 == 0 else None) for k in (1, 2, 5, 40) for i, c in enumerate(codes) if i % k == 0] + [("cold", codes[0], None, None)]
    heat = spark.createDataFrame([(d, s, 1) for d in days for s in ("s1", "s2", "s5", "s40")] + [(d, "cold", 25) for d in days], "trade_date date, sector_code string, heat_rank long")
    df = I.sector_leaders(
        spark.createDataFrame(bars, "stock_code string, trade_date date, change_pct double"), spark.createDataFrame(members, "sector_code string, stock_code string, start_date date, end_date date"),
        spark.createDataFrame([(c, d, "limit_up") for c, d in sorted(ups)], "stock_code string, trade_date date, event_type string"), spark.createDataFrame([(*key, v) for key, v in flows.items()], "stock_code string, trade_date date, main_net_inflow double"), heat,
    )
    low, expected = float("-inf"), []
    for d in days:
        for s in ("s1", "s2", "s5", "s40"):
            there = {c for n, c, _, end in members if n == s and (end is None or d <= end)}
            best = sorted((((c, d) not in ups, -(low if v is None else v), -flows.get((c, d), low), c) for c, x, v in bars if x == d and c in there))
            expected += [(d, s, i, c, not no) for i, (no, _, _, c) in enumerate(best[:3], 1)]
    assert sorted(map(tuple, df.collect())) == sorted(expected)
    windows = [x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "row_number" in x and "sector_code" in x.split("windowspecdefinition")[-1].split(" ASC")[0]]
    assert windows and not any("change_pct" in x.split("windowspecdefinition")[-1] for x in windows)


def test_medians_of_flow_sizes_by_cells(spark):
    """Even and odd numbers of rows, middles in one cell and in two, many zeros, nulls; no task takes all values of a size."""
    import statistics

    from tapeline.operators import quality as A

    sizes = {"below_1e4": [0.0] * 50 + [-0.5, 3.0, -9999.0], "below_1e5": [10000.0, -20000.0, 30000.0, 90000.0], "above": [1e5, 1e5, -100010.0, 5e9, 100020.0]}
    df = spark.createDataFrame([(v,) for vs in sizes.values() for v in vs] + [(None,)] * 3, "main_net_inflow double")
    out = A.unit_audit(df)
    got = {r.bucket: (r.n, r.low, r.high, r.median_size) for r in out.collect()}
    assert got == {k: (len(v), min(v), max(v), statistics.median(map(abs, v))) for k, v in sizes.items()} | {"null": (3, None, None, None)}
    assert out.columns == ["bucket", "n", "low", "high", "median_size"] and "percentile(" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_rules_are_screened_in_one_pass_over_the_frame(spark):
    """Rows that match none, one and several rules, and rows that lack inputs, as rule by rule; the
    stock days are read twice for all rules, and r17 sorts only what was found."""
    from tapeline.operators import strategy as S
    from tapeline.plans import strategy_queries as Q

    names = tuple(S.DEFAULTS)
    columns = ["open_price", "high_price", "low_price", "close_price", "change_pct", "amount_yuan", "prior_high", "prior_low", "ma5", "ma10", "ma20", "ma60", "volume_ratio", "amount_ratio", "volatility_20d", "close_position", "prev_ma5", "prev_ma10", "turnover_rate", "main_net_inflow", "main_net_ratio"]
    high = [9.8, 10.6, 9.5, 10.5, 5.0, 1e6, 10.4, 9.4, 10.3, 10.2, 10.0, 9.0, 2.0, 2.0, 1.0, 0.9, 10.0, 10.1, 9.0, 10.0, 1.0]
    rows = [(f"{i}", 1, *high, i % 2 == 0, i % 3 == 0, None if i % 4 else 1, 1 + i % 3, i % 25) for i in range(24)]
    rows += [(f"n{k}", 1, *[None if j == k else v for j, v in enumerate(high)], None, None, None, None, None) for k in range(len(high))]
    rows += [("low", 1, *[-1.0] * len(high), False, False, None, 0, None), ("x", 1, *[None] * len(high), None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "stock_code string, trade_date long, " + ", ".join(f"{c} double" for c in columns) + ", is_limit_up boolean, is_break boolean, open_count int, board_count long, best_rank long")
    one_by_one = sorted(tuple(r) for n in names for r in S.screen(frame, n).collect())
    out = S.screen_all(frame, names)
    assert sorted(map(tuple, out.collect())) == one_by_one and out.columns == ["stock_code", "trade_date", "rule", "score"] and {r[2] for r in one_by_one} == set(names)
    for query, scans, sorts in ((Q.screened, 2, 0), (Q.reconciled, 4, 2)):
        execution = query(spark, FOLDER)._jdf.queryExecution()
        assert execution.optimizedPlan().toString().count("InMemoryRelation") == scans and "Union" not in execution.optimizedPlan().toString()
        assert execution.executedPlan().toString().count("- Sort [rule") == sorts
