"""Strategy research: gates, rule screens, candidates, outcomes of signals, and parameter grids with a chronological holdout."""

from __future__ import annotations

import itertools
import math
import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import windows as W
from .factors import KEY

# Each rule's parameters by default.
DEFAULTS: dict[str, dict[str, float]] = {
    "trend_breakout": {"change_min": 2.0, "change_max": 9.5, "amount_ratio_min": 1.5, "close_position_min": 0.65},
    "bullish_alignment": {"change_min": 1.0, "volume_ratio_min": 1.2},
    "ma_golden_cross": {"change_min": 0.0, "volume_ratio_min": 1.2},
    "volume_price_surge": {"change_min": 3.0, "change_max": 9.5, "volume_ratio_min": 1.8, "amount_ratio_min": 1.5, "close_position_min": 0.70},
    "high_turnover_surge": {"change_min": 3.0, "change_max": 9.5, "turnover_rate_min": 8.0, "main_net_ratio_min": 0.0, "close_position_min": 0.65},
    "low_volatility_leader": {"volatility_20d_max": 2.5, "change_min": 2.0, "volume_ratio_min": 1.3, "close_position_min": 0.65},
    "pullback_ma20_bounce": {"ma20_touch_pct": 1.0, "volume_ratio_min": 1.0, "close_position_min": 0.60},
    "n_day_low_reversal": {"n_day_touch_pct": 2.0, "change_min": 2.0, "volume_ratio_min": 1.2, "close_position_min": 0.70},
    "theme_first_board_relay": {"max_heat_rank": 20},
    "consecutive_limit_up_relay": {"board_count_min": 2, "board_count_max": 4, "max_heat_rank": 10},
    "broken_board_recovery": {"change_min": 3.0, "volume_ratio_min": 1.5, "close_position_min": 0.72},
}


def evaluation_frame(bars: DataFrame, factors: DataFrame, basic: DataFrame | None = None, flow: DataFrame | None = None, events: DataFrame | None = None, boards: DataFrame | None = None, best_rank: DataFrame | None = None) -> DataFrame:
    """Everything that a rule reads of a stock and day: bar, factors, the row before, prior extremes, basic, flow, event, boards, best heat rank.

    Sides that are left out aren't joined, and their columns aren't there: a rule that reads them fails. Rules of bars and factors need no other."""
    f = factors.select(*KEY, "ma5", "ma10", "ma20", "ma60", "volume_ratio", "amount_ratio", "volatility_20d", "close_position", "history_days")
    df = bars.withColumns({"prior_high": W.prior_extreme("high_price", 20), "prior_low": W.prior_extreme("low_price", 20, "min")})
    df = df.join(f, KEY, "left").withColumns({"prev_ma5": W.lag_k("ma5", 1), "prev_ma10": W.lag_k("ma10", 1)})
    if basic is not None:
        df = df.join(basic.select(*KEY, "turnover_rate"), KEY, "left")
    if flow is not None:
        df = df.join(flow.select(*KEY, "main_net_inflow"), KEY, "left").withColumn("main_net_ratio", F.col("main_net_inflow") / F.when(F.col("amount_yuan") != 0, F.col("amount_yuan")) * 100)
    if events is not None:
        kinds = events.groupBy(*KEY).agg(F.max(F.col("event_type") == "limit_up").alias("is_limit_up"), F.max(F.col("event_type") == "limit_break").alias("is_break"), F.max(F.when(F.col("event_type") == "limit_up", F.col("open_count"))).alias("open_count"))
        df = df.join(kinds, KEY, "left")
    if boards is not None:
        df = df.join(boards.select(*KEY, "board_count"), KEY, "left")
    return df.join(best_rank, KEY, "left") if best_rank is not None else df


def rule(name: str, config: dict[str, float] | None = None) -> tuple[Column, Column]:
    """(whether a row matches, its score) as columns of an evaluation frame. A row that lacks an input doesn't match; the score
    only means something where it does."""
    p = DEFAULTS[name] | (config or {})
    c = F.col
    close, change, volume, amount, place = c("close_price"), c("change_pct"), c("volume_ratio"), c("amount_ratio"), c("close_position")
    up_to = lambda x, most: F.least(x, F.lit(float(most)))
    gap = lambda a, b: (a / F.when(b != 0, b) - 1) * 100
    bonus = lambda cond, n: F.when(cond, float(n)).otherwise(0.0)
    if name == "trend_breakout":
        ok = (close >= c("prior_high")) & (change >= p["change_min"]) & (change < p["change_max"]) & (amount >= p["amount_ratio_min"]) & (place >= p["close_position_min"])
        score = 45 + up_to((close / c("prior_high") - 1) * 1000, 20) + up_to(amount * 12, 20) + place * 18
    elif name == "bullish_alignment":
        ok = (close > c("ma5")) & (c("ma5") > c("ma10")) & (c("ma10") > c("ma20")) & (c("ma20") > c("ma60")) & (change >= p["change_min"]) & (volume >= p["volume_ratio_min"])
        score = 40 + gap(close, c("ma60")) * 2 + up_to(volume * 12, 20) + up_to(change * 3, 20)
    elif name == "ma_golden_cross":
        ok = (c("prev_ma5") <= c("prev_ma10")) & (c("ma5") > c("ma10")) & (change > p["change_min"]) & (volume >= p["volume_ratio_min"])
        score = 55 + up_to(gap(c("ma5"), c("ma10")) * 10, 20) + up_to(volume * 10, 15) + up_to(change * 2, 10)
    elif name == "volume_price_surge":
        ok = (change >= p["change_min"]) & (change < p["change_max"]) & (volume >= p["volume_ratio_min"]) & (amount >= p["amount_ratio_min"]) & (place >= p["close_position_min"])
        score = 35 + change * 4 + up_to(volume * 12, 25) + up_to(amount * 8, 15) + place * 15
    elif name == "high_turnover_surge":
        turnover, net = c("turnover_rate"), c("main_net_ratio")
        ok = (change >= p["change_min"]) & (change < p["change_max"]) & (turnover >= p["turnover_rate_min"]) & (c("main_net_inflow") > 0) & (net > p["main_net_ratio_min"]) & (place >= p["close_position_min"])
        score = 30 + change * 3 + up_to(turnover * 2.5, 25) + up_to(net * 3, 20) + place * 15
    elif name == "low_volatility_leader":
        ok = (close > c("ma20")) & (c("volatility_20d") <= p["volatility_20d_max"]) & (change >= p["change_min"]) & (volume >= p["volume_ratio_min"]) & (place >= p["close_position_min"])
        score = 45 + gap(close, c("ma20")) * 4 + F.greatest(F.lit(0.0), 20 - c("volatility_20d") * 6) + up_to(volume * 8, 15) + up_to(change * 2, 12)
    elif name == "pullback_ma20_bounce":
        touched = c("low_price") <= c("ma20") * (1 + p["ma20_touch_pct"] / 100)
        back = (close >= c("ma20")) & (close > c("open_price"))
        ok = touched & back & (c("ma5") >= c("ma10")) & (c("ma10") >= c("ma20")) & (volume >= p["volume_ratio_min"]) & (place >= p["close_position_min"])
        score = 45 + bonus(touched, 10) + bonus(back, 15) + up_to(volume * 8, 15) + place * 15
    elif name == "n_day_low_reversal":
        touched = c("low_price") <= c("prior_low") * (1 + p["n_day_touch_pct"] / 100)
        ok = touched & (close > c("open_price")) & (change >= p["change_min"]) & (place >= p["close_position_min"]) & (volume >= p["volume_ratio_min"])
        score = 40 + bonus(touched, 15) + up_to(change * 4, 25) + up_to(volume * 10, 15) + place * 12
    elif name in ("theme_first_board_relay", "consecutive_limit_up_relay"):
        opened = c("open_count").isNull() | (c("open_count") > 0) if p.get("minimum_open_count") is None else c("open_count") >= p["minimum_open_count"]
        natural, rank = F.coalesce(c("is_limit_up"), F.lit(False)) & opened, F.coalesce(c("best_rank"), F.lit(99))
        hot = c("best_rank") <= p["max_heat_rank"]
        if name == "theme_first_board_relay":
            ok = natural & (c("board_count") == 1) & hot
            score = 55 + bonus(natural, 20) + F.greatest(F.lit(0.0), 20 - rank) + bonus(c("board_count") == 1, 5)
        else:
            ok = natural & c("board_count").between(p["board_count_min"], p["board_count_max"]) & hot
            score = 50 + F.coalesce("board_count", F.lit(0)) * 8 + F.greatest(F.lit(0.0), 18 - rank) + bonus(natural, 12)
    else:
        broke = F.coalesce(c("is_break"), F.lit(False))
        ok = broke & (change >= p["change_min"]) & (place >= p["close_position_min"]) & (volume >= p["volume_ratio_min"])
        score = 35 + bonus(broke, 25) + up_to(change * 3, 20) + up_to(volume * 8, 12) + place * 12
    return F.coalesce(ok, F.lit(False)), F.least(score, F.lit(100.0))


def screen(frame: DataFrame, name: str, config: dict[str, float] | None = None) -> DataFrame:
    ok, score = rule(name, config)
    return frame.filter(ok).select(*KEY, F.lit(name).alias("rule"), F.round(score, 4).alias("score"))


def screen_all(frame: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """What `screen` gives for each of the rules, together. The frame is gone through once for all of them: a union would work it out for
    each rule, and Spark runs the parts of a union that are dealt alike one after another in the same task, which keeps all their memory."""
    found = [(n, *rule(n)) for n in names]
    matched = frame.filter(reduce(operator.or_, [ok for _, ok, _ in found]))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.round(score, 4).alias("score"), ok.alias("_ok")) for n, ok, score in found]))
    return matched.select(*KEY, each.alias("_")).filter("_._ok").select(*KEY, "_.rule", "_.score")


def universe_gate(frame: DataFrame, stocks: DataFrame, days: int = 60, amount: float = 80_000_000) -> DataFrame:
    """Adds reason: the first gate that a row fails, or null."""
    s = stocks.select("stock_code", "exchange", "is_st", "status")
    df = frame.join(F.broadcast(s), "stock_code", "left")
    c = F.col
    reason = F.coalesce(
        F.when(~F.coalesce(c("exchange"), F.lit("")).isin("SH", "SZ", "SSE", "SZSE"), "unsupported_exchange"), F.when(c("is_st"), "st_excluded"), F.when(F.coalesce(c("status"), F.lit("")) != "active", "inactive_stock"),
        F.when(F.coalesce(c("history_days"), F.lit(0)) < days, "listing_history_insufficient"), F.when(c("amount_yuan").isNull(), "amount_unavailable"), F.when(c("amount_yuan") < amount, "liquidity_insufficient"),
    )
    return df.withColumn("reason", reason)


def market_gate(signals: DataFrame, emotion: DataFrame, blocked: tuple[str, ...] = ("ice_point", "retreat"), least: float = 40.0, when_missing: bool = True) -> DataFrame:
    """Adds gate: why the day's market stops a signal, or null. emotion has one row a day."""
    df = signals.join(F.broadcast(emotion.select("trade_date", "stage", "risk_score")), "trade_date", "left")
    missing = F.lit(None) if when_missing else F.lit("market_emotion_unavailable")
    gate = F.when(F.col("stage").isNull(), missing).when(F.col("stage").isin(*blocked), F.concat(F.lit("market_stage_blocked:"), "stage")).when(F.col("risk_score") < least, "market_risk_on_below_threshold")
    return df.withColumn("gate", gate.cast("string")).drop("stage", "risk_score")


def candidates(screened: DataFrame, n: int) -> DataFrame:
    """The first n of each rule and day by score."""
    order = Window.partitionBy("rule", "trade_date").orderBy(F.desc_nulls_last("score"), "stock_code")
    return screened.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= n)


def reconcile_candidates(old: DataFrame, new: DataFrame, keys: list[str], open_: tuple[str, ...] = ("pending_confirmation", "watching")) -> DataFrame:
    """keys, status, action: new ones are created, open ones found again refreshed, and open ones not found cancelled; all others, such as
    entered or rejected ones, stay as they are."""
    df = old.select(*keys, F.col("status").alias("_old")).join(new.select(*keys, F.lit(True).alias("_new")), keys, "full")
    action = F.when(F.col("_old").isNull(), "created").when(~F.col("_old").isin(*open_), "kept").when(F.col("_new").isNotNull(), "refreshed").otherwise("cancelled")
    return df.select(*keys, F.when(action == "created", "pending_confirmation").when(action == "cancelled", "cancelled").otherwise(F.col("_old")).alias("status"), action.alias("action"))


def signal_outcomes(signals: DataFrame, bars: DataFrame, calendar: DataFrame, stop: float = -4.0, take: float = 8.0, activate: float = 6.0, drawdown: float = 3.0, days: int = 3, slip: float = 0.001, fee: float = 0.001) -> DataFrame:
    """Each signal bought at the next day's open and sold at the open after the first close that meets a condition: stop, then
    profit, then fall from the highest close, then time. No trade where a price is missing or not positive, or the calendar ends.

    The fan-out is a signal's `days` days: an equality on the stock and a bounded range of day numbers.
    """
    cal = F.broadcast(calendar.select("trade_date", "idx"))
    s = signals.select(*KEY).distinct().join(cal, "trade_date").withColumnRenamed("idx", "at")
    b = bars.join(cal, "trade_date").select("stock_code", "idx", "open_price", "close_price")
    entry = b.select("stock_code", (F.col("idx") - 1).alias("at"), F.col("open_price").alias("entry_open"))
    path = s.withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(days)))).withColumn("idx", F.col("at") + F.col("day"))
    path = path.join(b.select("stock_code", "idx", F.col("close_price").alias("close")), ["stock_code", "idx"]).join(entry.filter("entry_open > 0"), ["stock_code", "at"])
    paid = F.col("entry_open") * (1 + slip)
    w = Window.partitionBy("stock_code", "at").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    path = path.withColumns({"_r": (F.col("close") / paid - 1) * 100, "_peak": F.max("close").over(w)})
    peak_return = (F.col("_peak") / paid - 1) * 100
    fall = (F.col("_peak") - F.col("close")) / F.col("_peak") * 100
    why = F.when(F.col("_r") <= stop, "stop_loss").when(F.col("_r") >= take, "take_profit").when((peak_return >= activate) & (fall >= drawdown), "trailing_stop").when(F.col("day") == days, "time_exit")
    first = path.withColumn("why", why).filter("why is not null").groupBy("stock_code", "trade_date", "at", "entry_open").agg(F.min(F.struct("day", "why")).alias("x"))
    out = b.select("stock_code", F.col("idx").alias("sold_idx"), F.col("open_price").alias("exit_open")).filter("exit_open > 0")
    df = first.withColumn("sold_idx", F.col("at") + F.col("x.day") + 1).join(out, ["stock_code", "sold_idx"])
    gross = (F.col("exit_open") * (1 - slip) / (F.col("entry_open") * (1 + slip)) - 1) * 100
    return df.select(*KEY, F.col("x.why").alias("exit_reason"), (F.col("x.day") + 1).cast("long").alias("holding_days"), gross.alias("gross_return"), (gross - 2 * fee * 100).alias("net_return"))


def wilson_lower(wins: Column, n: Column, z: float = 1.96) -> Column:
    """The lower bound of a share of wins; null for none at all."""
    m = F.when(n > 0, n.cast("double"))
    p = wins / m
    return F.greatest(F.lit(0.0), (p + z * z / (2 * m) - z * F.sqrt((p * (1 - p) + z * z / (4 * m)) / m)) / (1 + z * z / m))


def trade_summary(trades: DataFrame, by: list[str]) -> DataFrame:
    """Sample, days, win rate, mean, median, profit factor (null without losses), best, worst and the lower bound of the win rate."""
    r = F.col("net_return")
    exact = lambda x: F.sum(x.cast("decimal(24,8)")).cast("double")
    gain, loss = exact(F.when(r > 0, r).otherwise(0)), exact(F.when(r < 0, -r).otherwise(0))
    return trades.groupBy(*by).agg(
        F.count("*").alias("trades"), F.countDistinct("trade_date").alias("days"), F.count_if(r > 0).alias("wins"), (F.count_if(r > 0) / F.count("*") * 100).alias("win_rate"), (exact(r) / F.count("*")).alias("mean_return"),
        F.percentile(r, F.lit(0.5)).alias("median_return"), (gain / F.when(loss > 0, loss)).alias("profit_factor"), F.max(r).alias("best"), F.min(r).alias("worst"),
    ).withColumn("wilson", F.round(wilson_lower(F.col("wins"), F.col("trades")), 6))


def qualify(summary: DataFrame, days: int = 120, trades: int = 300, rate: float = 50.0) -> DataFrame:
    ok = (F.col("days") >= days) & (F.col("trades") >= trades) & (F.col("win_rate") >= rate) & (F.col("mean_return") > 0)
    return summary.withColumn("qualified", ok)


def train_end_date(trades: DataFrame, share: float = 0.7, least: int = 110) -> DataFrame:
    """One row: the last day to learn from, the int(n * share)-th of the n days with trades; null below `least` days."""
    days = trades.select("trade_date").distinct().withColumn("_n", F.row_number().over(Window.orderBy("trade_date")))
    return days.agg(F.count("*").alias("days"), F.array_sort(F.collect_list("trade_date")).alias("_d")).select("days", F.when(F.col("days") >= least, F.element_at("_d", F.floor(F.col("days") * share).cast("int"))).alias("train_end"))


def grid(spark: SparkSession, base: dict[str, float], stricter: dict[str, list[float]], most: int = 1000) -> DataFrame:
    """trial, changes and a value for each parameter: every combination of the base's and stricter values, fewest changes first.

    Parameters ending in _max are stricter when lower; combinations whose bounds cross are none. The grid is configuration, not
    data: ValueError if it has more than `most` rows."""
    names = sorted(base)
    choices = [[base[n], *[v for v in stricter.get(n, []) if (v < base[n] if n.endswith("_max") else v > base[n])]] for n in names]
    rows = [dict(zip(names, values, strict=True)) for values in itertools.product(*choices)]
    rows = [r for r in rows if "change_min" not in r or "change_max" not in r or r["change_min"] < r["change_max"]]
    rows = [r for r in rows if "board_count_min" not in r or "board_count_max" not in r or r["board_count_min"] <= r["board_count_max"]]
    if len(rows) > most:
        raise ValueError(f"{len(rows)} combinations; at most {most} can be tried")
    changes = lambda r: sum(not math.isclose(r[n], base[n]) for n in names)
    rows.sort(key=lambda r: (changes(r), [r[n] for n in names]))
    return spark.createDataFrame([(i, changes(r), *[float(r[n]) for n in names]) for i, r in enumerate(rows)], "trial long, changes long, " + ", ".join(f"{n} double" for n in names))


def _within(facts: dict[str, str]) -> Column:
    """Whether a trade's facts are within a trial's bounds; a missing fact fails."""
    ok = F.lit(True)
    for name, fact in facts.items():
        ok = ok & ((F.col(fact) <= F.col(name)) if name.endswith("_max") else (F.col(fact) >= F.col(name)))
    return ok


def grid_reach(trades: DataFrame, trials: DataFrame, facts: dict[str, str]) -> DataFrame:
    """trials with how many trades, and on how many days, each lets through; 0 for none. Trials are at most 1000 rows and are sent to every task."""
    got = trades.crossJoin(F.broadcast(trials.select("trial", *facts))).filter(_within(facts)).groupBy("trial").agg(F.count("*").alias("trades"), F.countDistinct("trade_date").alias("days"))
    return trials.join(got, "trial", "left").fillna(0, ["trades", "days"])


def evaluate_grid(trades: DataFrame, trials: DataFrame, facts: dict[str, str], end: DataFrame) -> DataFrame:
    """Each trial's summary on the days to learn from and those held out. facts: the fact of a trade that each parameter bounds;
    a missing fact fails the trade. Trials are at most 1000 rows and are sent to every task."""
    df = trades.crossJoin(F.broadcast(trials)).filter(_within(facts)).crossJoin(F.broadcast(end.select("train_end")))
    return trade_summary(df.withColumn("split", F.when(F.col("trade_date") <= F.col("train_end"), "train").otherwise("test")), ["trial", "changes", "split"])


def rank_trials(results: DataFrame, train: tuple[int, int, float] = (300, 80, 48.0), test: tuple[int, int, float] = (120, 30, 50.0), most_drift: float = 8.0) -> DataFrame:
    """One row a trial: both splits, drift of the win rate, a verdict, and its place.

    train, test: the trades, days with signals and win rate that a split needs; both means must be above 0 as well. Eligible
    trials come first, then by lower bound, mean, median and trades of the test split; trials alike by their number.
    """
    columns = ("trades", "days", "win_rate", "mean_return", "median_return", "wilson")
    side = lambda s: results.filter(F.col("split") == s).select("trial", "changes", *[F.col(c).alias(f"{s}_{c}") for c in columns])
    df = side("train").join(side("test"), ["trial", "changes"], "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    df = df.withColumn("drift", F.round(F.abs(zero("train_win_rate") - zero("test_win_rate")), 4))
    enough, good = F.lit(True), F.col("drift") <= most_drift
    for s, (trades, days, rate) in (("train", train), ("test", test)):
        enough = enough & (zero(f"{s}_trades") >= trades) & (zero(f"{s}_days") >= days)
        good = good & (zero(f"{s}_win_rate") >= rate) & (zero(f"{s}_mean_return") > 0)
    df = df.withColumn("verdict", F.when(~enough, "data_insufficient").when(good, "eligible").otherwise("rejected"))
    known = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.lit(-999.0))
    order = Window.orderBy(F.desc(F.col("verdict") == "eligible"), F.desc(zero("test_wilson")), F.desc(known("test_mean_return")), F.desc(known("test_median_return")), F.desc(zero("test_trades")), "trial")  # at most 1000 rows
    return df.withColumn("place", F.row_number().over(order).cast("long"))


def peak_per_day(signals: DataFrame) -> DataFrame:
    """The most signals that each rule had on one day."""
    return signals.groupBy("rule", "trade_date").agg(F.count("*").alias("n")).groupBy("rule").agg(F.max("n").alias("peak"))


def cap_guard(signals: DataFrame, limit: int) -> DataFrame:
    return peak_per_day(signals).withColumn("hit_cap", F.col("peak") >= limit)


def realized_pnl(legs: DataFrame, trades: DataFrame, rate: float = 0.001) -> DataFrame:
    """By trade: what its sales brought, fees of both sides, profit in yuan and percent, and the mean price weighted by quantity."""
    exact = lambda x: F.sum(x.cast("decimal(28,6)")).cast("double")
    sold = legs.groupBy("trade_id").agg(exact(F.col("price") * F.col("quantity")).alias("sell_amount"), F.sum("quantity").alias("quantity"))
    df = trades.join(sold, "trade_id")
    bought = F.col("entry_price") * F.col("quantity")
    fees = (bought + F.col("sell_amount")) * rate
    pnl = F.col("sell_amount") - bought - fees
    return df.select("trade_id", "sell_amount", fees.alias("fees"), pnl.alias("pnl"), (pnl / F.when(bought != 0, bought) * 100).alias("pnl_pct"), (F.col("sell_amount") / F.when(F.col("quantity") != 0, F.col("quantity"))).alias("exit_price"))


def strategy_summary(items: DataFrame) -> DataFrame:
    """By rule: how many are open, pending and closed, the last day, and the mean return of closed ones."""
    return items.groupBy("rule").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("open", "pending", "closed")], F.max("trade_date").alias("latest"), F.round(F.avg(F.when(F.col("status") == "closed", F.col("value"))), 4).alias("mean_closed"))


def series(df: DataFrame, key: str, columns: list[str], order: str = "trade_date") -> DataFrame:
    """One row a key with arrays of its columns in order."""
    found = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("_s"))
    return found.select(key, *[F.col(f"_s.{c}").alias(c) for c in (order, *columns)])
