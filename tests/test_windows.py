"""Window helpers and factors against values worked out by hand."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tapeline.functions import windows as W
from tapeline.operators import factors as X
from tapeline.operators import insight as I
from tapeline.operators import strategy as S

BAR = "stock_code string, trade_date date, open_price double, high_price double, low_price double, close_price double, pre_close_price double, change_pct double, volume_hand long, amount_yuan double"


def rising(spark, days, code="000001"):
    rows, day = [], date(2024, 1, 1)
    for i in range(days):
        c = 100.0 + i
        rows.append((code, day + timedelta(days=i), c, c + 2, c - 2, c, c - 1 if i else None, None, 100, 1000.0))
    return spark.createDataFrame(rows, BAR)


def test_means_of_twenty_rising_closes(spark):
    last = X.daily_factors(rising(spark, 20)).orderBy(F.desc("trade_date")).first()
    assert (last.ma5, last.ma20, last.ma30, last.history_days) == (117.0, 109.5, 109.5, 20)
    assert "ma30" in last.missing and "ma20" not in last.missing.split(",")


def test_means_of_sixty_rising_closes(spark):
    last = X.daily_factors(rising(spark, 60)).orderBy(F.desc("trade_date")).first()
    assert (last.ma30, last.ma60) == (144.5, 129.5)


def test_a_further_day_changes_no_day_before(spark):
    a, b = X.daily_factors(rising(spark, 30)).collect(), X.daily_factors(rising(spark, 31)).collect()
    assert sorted(map(tuple, a)) == sorted(tuple(r) for r in b if r.history_days <= 30)


def test_streak_looks_back_only(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1, 1, -1, 1, None, 1, 1])], "stock_code string, trade_date int, v int")
    assert [r.n for r in W.streak(df, F.col("v") > 0, "n").orderBy("trade_date").collect()] == [1, 2, 0, 1, 0, 1, 2]


@pytest.mark.parametrize(("value", "negative", "expected"), [(2.0, False, 50.0), (3.0, True, 12.5)])
def test_history_percentile(spark, value, negative, expected):
    df = spark.createDataFrame([("m", i, v) for i, v in enumerate([1.0, 2.0, 2.0, 3.0, value])], "metric string, day int, v double")
    last = W.history_percentile(df, ["metric"], "day", "v", 120, F.lit(negative)).orderBy(F.desc("day")).first()
    assert (last.sample, last.percentile) == (4, expected)


def test_one_word_boards(spark):
    df = spark.createDataFrame([(11.0, 11.0, 0), (11.0, 10.5, 0), (11.0, 11.0, 1), (None, 11.0, 0)], "l double, o double, n int")
    assert [r[0] for r in df.select(I.one_word(F.col("l"), F.col("o"), F.col("n"))).collect()] == [True, False, False, False]


def test_average_rank_percentiles_share_ties(spark):
    df = spark.createDataFrame([("d", v) for v in (1, 2, 2, 3)], "trade_date string, v int")
    assert sorted(r[0] for r in df.select(W.avg_rank_pct("v")).collect()) == [0.0, 50.0, 50.0, 100.0]
    assert spark.createDataFrame([("d", 5)], "trade_date string, v int").select(W.avg_rank_pct("v")).first()[0] == 100.0


def test_outcome_enters_the_next_day_and_stops(spark):
    bars = rising(spark, 6).withColumn("close_price", F.when(F.col("trade_date") == "2024-01-02", 90.0).otherwise(F.col("close_price")))
    calendar = bars.select("trade_date", F.row_number().over(W.by("stock_code")).cast("long").alias("idx"))
    signals = bars.filter("trade_date = '2024-01-01'").select("stock_code", "trade_date")
    out = S.signal_outcomes(signals, bars, calendar).collect()
    assert [(r.exit_reason, r.holding_days) for r in out] == [("stop_loss", 2)]


def test_grid_is_stricter_only_and_ordered_by_changes(spark):
    rows = S.grid(spark, {"change_min": 2.0}, {"change_min": [1.0, 3.0]}).collect()
    assert [(r.changes, r.change_min) for r in rows] == [(0, 2.0), (1, 3.0)]


def test_entity_windows_share_one_exchange(spark):
    plan = X.daily_factors(rising(spark, 5))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1


def test_moving_means_and_gaps_equal_a_loop(spark):
    """Two stocks, nulls and values of very different size: a running sum loses nothing."""
    rng = random.Random(5)
    rows = [(c, date(2020, 1, 1) + timedelta(days=i), None if rng.random() < 0.2 else rng.choice([1e-6, 1.0, 1e9]) * rng.random()) for c in "ab" for i in range(300)]
    df = spark.createDataFrame(rows, "stock_code string, trade_date date, x double")
    got = W.moving_means(df, "x", (1, 5, 250)).withColumns({f"ok_{n}": W.guarded(F.lit(1), "x", n) for n in (1, 5)})
    found = {(r.stock_code, r.trade_date): r for r in got.collect()}
    for code in "ab":
        own = [r for r in rows if r[0] == code]
        for i, (_, day, _) in enumerate(own):
            r = found[code, day]
            for n in (1, 5, 250):
                known = [v for *_, v in own[max(0, i - n + 1) : i + 1] if v is not None]
                assert (r[f"mean_{n}"] is None) == (not known) and (not known or abs(r[f"mean_{n}"] - math.fsum(known) / len(known)) <= 1e-15 * max(1, max(known)))
            for n in (1, 5):
                assert r[f"ok_{n}"] == (None if any(v is None for *_, v in own[max(0, i - n + 1) : i + 1]) else 1)


def test_overlapping_spans_give_a_sector_once(spark):
    """Open bounds, spans inside others, equal starts and a span that ends before it begins, against each day asked for by itself."""
    rng = random.Random(6)
    day = lambda i: date(2024, 1, 1) + timedelta(days=i)
    spans = [(s, c, None if rng.random() < 0.15 else day(a), None if rng.random() < 0.15 else day(a + rng.randint(-2, 6))) for s in "xy" for c in "abcdef" for a in rng.sample(range(30), 4)]
    members = spark.createDataFrame(spans * 2, "sector_code string, stock_code string, start_date date, end_date date")
    facts = spark.createDataFrame([(c, day(i), i) for c in "abcdefg" for i in range(40)], "stock_code string, trade_date date, i int")
    got = sorted((r.stock_code, r.i, r.sector_code) for r in X.membership_asof(facts, members).collect())
    inside = lambda d, a, b: (a is None or a <= d) and (b is None or d <= b)
    assert got == sorted({(c, i, s) for s, c, a, b in spans for i in range(40) if inside(day(i), a, b)})
