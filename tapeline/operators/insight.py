"""Market insight: breadth, sentiment, emotion, concept heat, evidence and validation.

Sides that are broadcast here are the stock master (a row a listed stock), calendars (a row a day) and sector names: bounded by the market, not
by the length of history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import windows as W
from .factors import KEY, membership_asof

def per_day() -> WindowSpec:
    """For frames of one row a day only."""
    return Window.orderBy("trade_date")


def ratio(a: Column | str, b: Column | str, scale: float = 100) -> Column:
    b = F.col(b) if isinstance(b, str) else b
    return (F.col(a) if isinstance(a, str) else a) / F.when(b != 0, b) * scale


def clamp(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), x)))


def money(c: str) -> Column:
    """A sum of yuan that doesn't depend on the order of rows."""
    return F.sum(F.col(c).cast("decimal(20,2)")).cast("double")


def mean6(c: str) -> Column:
    """A mean of values to six decimals that doesn't depend on the order of rows."""
    return F.sum(F.col(c).cast("decimal(20,6)")).cast("double") / F.when(F.count(c) > 0, F.count(c))


def eligible(stocks: DataFrame) -> DataFrame:
    return stocks.filter((F.col("status") == "active") & ~F.col("is_st") & F.col("exchange").isin("SH", "SZ", "SSE", "SZSE"))


def breadth(bars: DataFrame, stocks: DataFrame) -> DataFrame:
    """By day over eligible stocks: counts by direction, mean and exact median change, amount."""
    c = F.col("change_pct")
    return bars.join(F.broadcast(eligible(stocks).select("stock_code")), "stock_code").groupBy("trade_date").agg(
        F.count("*").alias("daily_bar_count"), F.count_if(c > 0).alias("up_count"), F.count_if(c < 0).alias("down_count"), F.count_if(c == 0).alias("flat_count"),
        F.round(F.avg(c), 6).alias("average_change"), F.percentile(c, F.lit(0.5)).alias("median_change"), money("amount_yuan").alias("total_amount"),
    )


def limit_counts(events: DataFrame) -> DataFrame:
    kinds = ("limit_up", "limit_down", "limit_break")
    return events.groupBy("trade_date").agg(*[F.count_if(F.col("event_type") == k).alias(f"{k}_count") for k in kinds])


def prev_day_join(bars: DataFrame, events: DataFrame, calendar: DataFrame) -> DataFrame:
    """Bars of stocks that had an event on the open day before."""
    before = calendar.select("trade_date", "previous_trade_date")
    had = events.select("stock_code", F.col("trade_date").alias("previous_trade_date")).distinct()
    return bars.join(F.broadcast(before), "trade_date").join(had, ["stock_code", "previous_trade_date"])


def limit_up_premium(bars: DataFrame, events: DataFrame, calendar: DataFrame) -> DataFrame:
    """Mean change today of the stocks that were limit-up on the open day before."""
    return prev_day_join(bars, events.filter("event_type = 'limit_up'"), calendar).groupBy("trade_date").agg(F.round(F.avg("change_pct"), 6).alias("premium"), F.count("change_pct").alias("stock_count"))


def kth_open_after(stocks: DataFrame, calendar: DataFrame, k: int) -> DataFrame:
    """stock_code and kth_date: the k-th open day on or after listing, counting from 0, by number of day."""
    days = calendar.select("trade_date", "idx")
    # Each date up to an open day, and after the one before it, has that day's number; dates before the calendar have the first.
    before = F.lag("trade_date").over(Window.orderBy("idx"))
    filled = days.withColumn("_from", F.coalesce(F.date_add(before, 1), "trade_date")).select(F.explode(F.sequence("_from", "trade_date")).alias("_listed"), F.col("idx").alias("first"))
    start = calendar.agg(F.min("trade_date").alias("_start"))
    at = stocks.filter("list_date is not null").crossJoin(F.broadcast(start)).withColumn("_listed", F.greatest("list_date", "_start"))  # one row
    at = at.join(F.broadcast(filled), "_listed").select("stock_code", "first")
    return at.join(F.broadcast(days.withColumnRenamed("trade_date", "kth_date")), F.col("idx") == F.col("first") + k).select("stock_code", "kth_date")


def market_metrics(bars: DataFrame, stocks: DataFrame, flow: DataFrame, factors: DataFrame, basic: DataFrame, calendar: DataFrame) -> DataFrame:
    """Breadth and more, by day, over eligible stocks from their sixth open day on."""
    aged = kth_open_after(eligible(stocks), calendar, 5)
    df = bars.join(F.broadcast(aged), "stock_code").filter("trade_date >= kth_date")
    df = df.join(flow.select(*KEY, "main_net_inflow"), KEY, "left").join(factors.select(*KEY, "ma20", "ma60", "volatility_20d", "amount_ratio"), KEY, "left").join(basic.select(*KEY, "turnover_rate"), KEY, "left")
    c = F.col("change_pct")
    return df.groupBy("trade_date").agg(
        F.count("*").alias("daily_bar_count"), F.count_if(c > 0).alias("up_count"), F.count_if(c < 0).alias("down_count"), F.percentile(c, F.lit(0.5)).alias("median_change_pct"),
        F.count_if(c >= 5).alias("wide_up_count"), F.count_if(c <= -5).alias("wide_down_count"), money("amount_yuan").alias("total_amount_yuan"), money("main_net_inflow").alias("main_net_inflow"),
        F.count_if(F.col("close_price") >= F.col("ma20")).alias("above_ma20_count"), F.count_if(F.col("close_price") >= F.col("ma60")).alias("above_ma60_count"), F.count("ma20").alias("factor_count"),
        *[mean6(c).alias(c) for c in ("volatility_20d", "amount_ratio", "turnover_rate")],
    )


def new_high_low(bars: DataFrame, stocks: DataFrame, calendar: DataFrame) -> DataFrame:
    """By day, of stocks listed 20 open days or more: closes at the extremes of their last 20, today included."""
    aged = kth_open_after(eligible(stocks), calendar, 19)
    df = bars.withColumns({"_hi": W.rolling_extreme("close_price", 20), "_lo": W.rolling_extreme("close_price", 20, "min")}).join(F.broadcast(aged), "stock_code").filter("trade_date >= kth_date")
    return df.groupBy("trade_date").agg(F.count("*").alias("stock_count"), F.count_if(F.col("close_price") >= F.col("_hi")).alias("new_high_20"), F.count_if(F.col("close_price") <= F.col("_lo")).alias("new_low_20"))


def concept_metrics(bars: DataFrame, members: DataFrame, events: DataFrame, flow: DataFrame) -> DataFrame:
    """By day and concept, over its members then: counts, mean and median change, net inflow (null if no member has one)."""
    ups = events.filter("event_type = 'limit_up'").select(*KEY, F.lit(1).alias("up")).distinct()
    rows = membership_asof(bars.join(ups, KEY, "left").join(flow.select(*KEY, "main_net_inflow"), KEY, "left"), members)
    c = F.col("change_pct")
    return rows.groupBy("trade_date", "sector_code").agg(
        F.count(c).alias("priced"), F.count_if(c > 0).alias("rising"), F.count_if(c < 0).alias("falling"), F.count("up").alias("limit_ups"), F.count("main_net_inflow").alias("flow_count"),
        F.round(F.avg(c), 6).alias("average_change"), F.percentile(c, F.lit(0.5)).alias("median_change"), money("main_net_inflow").alias("net_inflow"),
    )


def index_metrics(index_bars: DataFrame) -> DataFrame:
    """Mean change and mean range of the core indexes by day."""
    df = index_bars.withColumn("_c", (F.col("close_price") / F.col("pre_close_price") - 1) * 100)
    return df.groupBy("trade_date").agg(F.round(F.avg("_c"), 6).alias("index_change"), F.round(F.avg(ratio(F.col("high_price") - F.col("low_price"), "close_price")), 6).alias("index_amplitude"), F.count("*").alias("n"))


def asof_sum(days: DataFrame, facts: DataFrame, value: str, out: str) -> DataFrame:
    """days with the latest fact date not after each and the sum of its values: days and fact dates are put in one order."""
    sums = facts.groupBy("trade_date").agg(money(value).alias("_v"))
    both = days.select("trade_date").distinct().withColumn("_day", F.lit(1)).join(sums, "trade_date", "full")
    w = Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_v").isNotNull(), F.struct("trade_date", "_v")), ignorenulls=True).over(w)
    return both.withColumn("_l", last).filter("_day = 1").select("trade_date", F.col("_l.trade_date").alias("as_of"), F.col("_l._v").alias(out))


def sentiment(breadth_: DataFrame, counts: DataFrame, premium: DataFrame, boards: DataFrame, active: int | Column, complete: DataFrame | None = None) -> DataFrame:
    """Score and stage by day from six components, weighed anew over those there are; pending below 95 % coverage or where
    the day's events aren't complete. active: how many stocks there are. All frames have one row a day."""
    active = F.lit(active) if isinstance(active, int) else active
    df = breadth_.join(counts, "trade_date", "left").join(premium, "trade_date", "left").join(boards, "trade_date", "left")
    df = W.baseline_ratio(df, "total_amount", 5, 3, "amount_ratio")
    done = df.join(complete.select("trade_date", F.lit(True).alias("_done")).distinct(), "trade_date", "left") if complete is not None else df.withColumn("_done", F.lit(True))
    n = active.cast("double")
    ups, breaks = (F.coalesce(f"limit_{k}_count", F.lit(0)) for k in ("up", "break"))
    parts = [
        (0.30, ratio("up_count", n)), (0.20, clamp(50 + 12.5 * F.col("median_change"))), (0.20, clamp(ups / n * 5000)),
        (0.10, ratio(ups, ups + breaks)), (0.12, clamp(50 + 10 * F.col("premium"))), (0.08, clamp((F.col("amount_ratio") - 0.6) / 0.8 * 100)),
    ]
    weight = sum((F.when(x.isNotNull(), w).otherwise(0.0) for w, x in parts), F.lit(0.0))
    total = sum((F.coalesce(x, F.lit(0.0)) * w for w, x in parts), F.lit(0.0))
    ready = (ratio("daily_bar_count", n) >= 95) & F.coalesce("_done", F.lit(False))
    df = done.withColumn("score", F.when(ready, F.round(total / weight, 4))).withColumn("status", F.when(ready, "ready").otherwise("pending"))
    return df.select("trade_date", "status", "score", sentiment_stage("score", F.col("highest_board"), F.col("premium")).alias("stage"))


def sentiment_stage(name: str, board: Column, premium: Column) -> Column:
    """By the score of that name, of frames with one row a day; main_up asks for the last two scores, pending days passed over."""
    score = F.col(name)
    one, two = (F.expr(f"lag({name}, {k}) ignore nulls over (order by trade_date)") for k in (1, 2))
    strong = F.coalesce((one >= 70) & (two >= 70), F.lit(False)) & (F.coalesce(board, F.lit(0)) >= 3) & (F.coalesce(premium, F.lit(0.0)) >= 0)
    return F.when(score.isNull(), "pending").when(score <= 25, "ice_point").when(score < 40, "retreat").when(score < 60, "chaos").when(score < 75, "recovery").when(strong, "main_up").otherwise("active")


def one_word(limit_price: Column, open_price: Column, open_count: Column) -> Column:
    """Locked at the limit all day."""
    return F.coalesce((F.abs(limit_price - open_price) < 0.0001) & (open_count == 0), F.lit(False))


def concept_heat(metrics: DataFrame, ready: DataFrame | None = None, least: int = 3) -> DataFrame:
    """Heat and rank of each concept with enough priced members, by day: places of return (.35), limit-up density (.25) and inflow
    (.15) among the day's, and breadth (.25), weighed anew over those there are. Without a ready day both are null."""
    df = metrics.filter(F.col("priced") >= least)
    df = df.withColumns({"_density": F.col("limit_ups") / F.col("priced"), "_flow": F.when(F.col("flow_count") > 0, F.col("net_inflow"))})
    df = df.withColumns({"p_return": W.avg_rank_pct("average_change"), "p_density": W.avg_rank_pct("_density"), "p_flow": W.avg_rank_pct("_flow"), "breadth": F.col("rising") / F.col("priced") * 100})
    parts = [(0.35, "p_return"), (0.25, "breadth"), (0.25, "p_density"), (0.15, "p_flow")]
    weight = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for w, c in parts), F.lit(0.0))
    df = df.withColumn("heat", F.round(sum((F.coalesce(c, F.lit(0.0)) * w for w, c in parts), F.lit(0.0)) / weight, 4))
    rank = F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc_nulls_last("heat"), F.desc_nulls_last("average_change"), "sector_code"))
    df = df.withColumn("heat_rank", rank.cast("long"))
    if ready is not None:
        df = df.join(F.broadcast(ready.select("trade_date", F.lit(True).alias("_ready")).distinct()), "trade_date", "left")
        df = df.withColumns({"heat": F.when(F.col("_ready"), F.col("heat")), "heat_rank": F.when(F.col("_ready"), F.col("heat_rank"))})
    return df.select("trade_date", "sector_code", "heat", "heat_rank", "priced", "limit_ups")


def sector_leaders(bars: DataFrame, members: DataFrame, events: DataFrame, flow: DataFrame, heat: DataFrame, sectors: int = 24, k: int = 3) -> DataFrame:
    """The first k stocks of each of the day's hottest sectors: limit-ups first, then by change and inflow.

    A stock's place among all of its day is the same in each of its sectors, so it is told before sectors are met. Stocks by sectors, the
    large side, are neither shuffled nor sorted: they are gone through for the best place in each of 4k cells of a sector and day, and
    again for those not behind the k-th best of these. That bound, a row a day and sector, is broadcast.
    """
    ups = events.filter("event_type = 'limit_up'").select(*KEY, F.lit(1).alias("up")).distinct()
    rows = bars.select(*KEY, "change_pct").join(ups, KEY, "left").join(flow.select(*KEY, "main_net_inflow"), KEY, "left")
    order = Window.partitionBy("trade_date").orderBy(F.desc_nulls_last("up"), F.desc_nulls_last("change_pct"), F.desc_nulls_last("main_net_inflow"), "stock_code")
    met = membership_asof(rows.withColumn("_at", F.row_number().over(order)).select(*KEY, "up", "_at"), members)
    sector = ["trade_date", "sector_code"]
    cells = met.groupBy(*sector, F.pmod(F.xxhash64("stock_code"), F.lit(4 * k)).alias("_cell")).agg(F.min("_at").alias("_best"))
    bound = cells.groupBy(*sector).agg(F.get(F.array_sort(F.collect_list("_best")), F.lit(k - 1)).alias("_bound"))  # null: fewer than k cells
    bound = bound.join(heat.filter(F.col("heat_rank") <= sectors).select(*sector), sector, "left_semi")
    near = met.join(F.broadcast(bound), sector).filter("_bound is null or _at <= _bound")
    df = near.withColumn("place", F.row_number().over(Window.partitionBy(*sector).orderBy("_at")).cast("long")).filter(F.col("place") <= k)
    return df.select(*sector, "place", "stock_code", F.col("up").isNotNull().alias("limit_up"))


def emotion_raw(market: DataFrame, events: DataFrame, bars: DataFrame, boards: DataFrame, heat: DataFrame, premium: DataFrame, index: DataFrame, highs: DataFrame, calendar: DataFrame) -> DataFrame:
    """The day's raw metrics, one row a day: limit structure, promotion, themes, breadth, money, trend."""
    e = events.join(bars.select(*KEY, "open_price"), KEY, "left")
    up = F.col("event_type") == "limit_up"
    locked = one_word(F.col("limit_price"), F.col("open_price"), F.col("open_count"))
    limits = e.groupBy("trade_date").agg(F.count_if(up).alias("ups"), F.count_if(up & locked).alias("one_word"), F.count_if(up & ~locked).alias("natural"), F.count_if(F.col("event_type") == "limit_down").alias("downs"), F.count_if(F.col("event_type") == "limit_break").alias("breaks"))
    ladder = boards.groupBy("trade_date").agg(F.max("board_count").alias("highest"), F.count_if(F.col("board_count") >= 2).alias("multi"))
    # What was there on the open day before is the row before of the same stock or sector, if it is of that day; and of days, the row before.
    dates = F.broadcast(calendar.select("trade_date", "previous_trade_date"))
    held = lambda df, key: df.withColumn("_last", F.lag("trade_date").over(W.by(key))).join(dates, "trade_date").withColumn("_held", F.coalesce(F.col("_last") == F.col("previous_trade_date"), F.lit(False)))
    ups = held(events.filter(up).select(*KEY).distinct(), "stock_code").groupBy("trade_date").agg(F.count("*").alias("had"), F.count_if("_held").alias("kept"))
    best = lambda c: F.max(F.when(F.col("heat_rank") == 1, c))
    top = held(heat.filter("heat_rank <= 5").select("sector_code", "trade_date", "heat_rank", "limit_ups", "priced", "heat"), "sector_code")
    themes = top.groupBy("trade_date").agg(F.count("*").alias("top"), F.count_if("_held").alias("again"), best(ratio("limit_ups", "priced")).alias("theme_limit_up_density"), best(F.col("heat")).alias("leader_strength"))
    days = calendar.select("trade_date").join(ups, "trade_date", "left").join(themes, "trade_date", "left").withColumns({"had": F.lag("had").over(per_day()), "top_before": F.lag("top").over(per_day())}).drop("top")
    df = market
    for other in (limits, ladder, days, premium.select("trade_date", F.col("premium").alias("previous_limit_up_premium")), index.select("trade_date", "index_change", "index_amplitude"), highs):
        df = df.join(other, "trade_date", "left")
    z = lambda c: F.coalesce(c, F.lit(0))
    df = W.baseline_ratio(df, "total_amount_yuan", 5, 5, "amount_vs_5d_average")
    n = F.col("daily_bar_count")
    return df.select(
        "trade_date", z("natural").alias("natural_limit_up_count"), z("downs").alias("qualified_limit_down_count"), ratio(z("downs"), n).alias("qualified_limit_down_density"),
        ratio(z("breaks"), z("ups") + z("breaks")).alias("limit_break_rate"), ratio(z("kept"), "had").alias("board_promotion_rate"), (z("highest") * 10 + F.least(z("multi"), F.lit(10))).cast("double").alias("board_structure"), z("highest").alias("highest_board_count"),
        ratio("up_count", n).alias("up_ratio_pct"), "median_change_pct", ratio("wide_up_count", F.col("wide_up_count") + F.col("wide_down_count")).alias("wide_move_ratio"), "previous_limit_up_premium", "theme_limit_up_density",
        ratio(z("again"), "top_before").alias("theme_persistence"), "leader_strength", F.round("amount_vs_5d_average", 4).alias("amount_vs_5d_average"), F.col("main_net_inflow").alias("main_net_inflow_strength"),
        ratio("above_ma20_count", "factor_count").alias("above_ma20_ratio"), ratio("above_ma60_count", "factor_count").alias("above_ma60_ratio"), (ratio("new_high_20", "stock_count") - ratio("new_low_20", "stock_count")).alias("new_high_low_spread"),
        F.when(F.col("amount_ratio").isNull(), F.col("turnover_rate")).when(F.col("turnover_rate").isNull(), F.col("amount_ratio")).otherwise((F.col("amount_ratio") + F.col("turnover_rate")) / 2).alias("turnover_volume_expansion"),
        F.col("index_change").alias("core_index_trend"), "index_amplitude", "volatility_20d",
    )


# Metrics that count the other way around, and the two cards' weights and thresholds by default.
NEGATIVE = ("qualified_limit_down_count", "limit_break_rate", "index_amplitude", "qualified_limit_down_density", "volatility_20d")
SHORT_TERM = {
    "natural_limit_up_count": 8, "qualified_limit_down_count": 6, "limit_break_rate": 8, "board_promotion_rate": 9, "board_structure": 9, "up_ratio_pct": 6, "median_change_pct": 6, "wide_move_ratio": 7,
    "previous_limit_up_premium": 6, "theme_limit_up_density": 7, "theme_persistence": 7, "leader_strength": 6, "amount_vs_5d_average": 6, "main_net_inflow_strength": 5, "north_money": 4,
}
RISK_ON = {
    "up_ratio_pct": 10, "median_change_pct": 10, "wide_move_ratio": 10, "above_ma20_ratio": 8, "above_ma60_ratio": 8, "new_high_low_spread": 9, "amount_vs_5d_average": 8, "main_net_inflow_strength": 8,
    "north_money": 4, "turnover_volume_expansion": 5, "core_index_trend": 8, "index_amplitude": 5, "qualified_limit_down_density": 4, "volatility_20d": 3,
}
THRESHOLDS = {"ice_point": 28, "recovery": 48, "active": 65, "climax": 82, "retreat": 42}


def emotion_percentiles(raw: DataFrame, days: int = 120) -> DataFrame:
    """trade_date, metric, value, sample, percentile: each metric against its own history, one row a day and metric."""
    names = [c for c in raw.columns if c in SHORT_TERM or c in RISK_ON]
    long = raw.select("trade_date", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select("trade_date", "m.metric", "m.value")
    return W.history_percentile(long, ["metric"], "trade_date", "value", days, F.col("metric").isin(*NEGATIVE))


def emotion_scores(percentiles: DataFrame, least: int = 60) -> DataFrame:
    """trade_date, short_score, risk_score: weights are shared anew over the metrics with a value and enough history."""
    weigh = lambda card: F.coalesce(F.create_map(*[x for k, v in card.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("metric")], F.lit(0.0))
    usable = F.col("value").isNotNull() & (F.col("sample") >= least)
    df = percentiles.withColumns({"_s": F.when(usable, weigh(SHORT_TERM)).otherwise(0.0), "_r": F.when(usable, weigh(RISK_ON)).otherwise(0.0), "_p": F.coalesce("percentile", F.lit(0.0))})
    card = lambda w: F.sum(F.col(w) * F.col("_p")) / F.when(F.sum(w) > 0, F.sum(w))
    return df.groupBy("trade_date").agg(F.round(card("_s"), 8).alias("short_score"), F.round(card("_r"), 8).alias("risk_score"))


def emotion_stages(scores: DataFrame, raw: DataFrame, limits: dict[str, float] = THRESHOLDS) -> DataFrame:
    """Primary stage by priority ice, retreat, climax, recovery, active; auxiliary state. Days without both scores are left out."""
    df = scores.filter("short_score is not null and risk_score is not null").join(raw, "trade_date")
    high, slope = W.recent_high_and_slope("short_score", per_day())
    df = df.withColumns({"_high": high, "slope": slope})
    s, r, t = F.col("short_score"), F.col("risk_score"), limits
    downs, ups = F.col("qualified_limit_down_count"), F.col("natural_limit_up_count")
    stage = (
        F.when((s <= t["ice_point"]) & (r <= t["retreat"]) & (F.col("slope") <= 0), "ice_point").when((s < t["retreat"]) & ((F.col("slope") < 0) | (downs > ups)), "retreat")
        .when((s >= t["climax"]) & (r >= t["active"]) & (ups > 0), "climax").when((s >= t["recovery"]) & (F.col("slope") > 0) & (r >= t["retreat"]), "recovery").otherwise("active")
    )
    aux = (
        F.when((F.col("limit_break_rate") >= 40) & (F.col("_high") - s >= 12), "divergence").when((downs >= F.greatest(F.lit(8), ups)) & (s < 40), "panic_release")
        .when((F.col("board_promotion_rate") >= 35) & (F.col("highest_board_count") >= 3), "acceleration").when(F.col("theme_persistence") >= 40, "ferment")
        .when((s < 50) & (F.coalesce("theme_persistence", F.lit(0.0)) < 20), "rotation").otherwise("trial")
    )
    return df.select("trade_date", "short_score", "risk_score", F.round("slope", 6).alias("slope"), stage.alias("stage"), aux.alias("auxiliary"))


def forward_validation(scores: DataFrame, raw: DataFrame, least: int = 15) -> DataFrame:
    """What followed each score: rows by score (short, risk), horizon (1 and 3 days) and bucket (low below 40, middle below 70, high, all).

    sample, mean breadth of the horizon's last day and mean core index return compounded up to it, shares of samples above 50 and above 0. On
    `all` also both rank correlations with the score, high less low of both means, and the relationship: positive or inverse if neither difference
    says otherwise, mixed, or insufficient with under `least` samples on a side. A day counts where one of both outcomes is known.
    """
    ahead = {f"_{h}": F.struct(F.lit(h).alias("horizon"), F.lead("up_ratio_pct", h).over(per_day()).alias("breadth"), F.round(W.forward_compound("core_index_trend", h, per_day()), 4).alias("core")) for h in (1, 3)}
    df = raw.withColumns(ahead).select("trade_date", F.explode(F.array(*ahead)).alias("_")).select("trade_date", "_.*")
    long = scores.select("trade_date", F.explode(F.array(*[F.struct(F.lit(n).alias("score"), F.col(f"{n}_score").alias("value")) for n in ("short", "risk")])).alias("_")).select("trade_date", "_.*").filter("value is not null")
    df = long.join(df.filter("breadth is not null or core is not null"), "trade_date")
    bucket = F.when(F.col("value") < 40, "low").when(F.col("value") < 70, "middle").otherwise("high")
    keys = ["score", "horizon"]
    above = lambda c, t: F.count_if(F.col(c) > t) / F.when(F.count(c) > 0, F.count(c)) * 100
    both = df.withColumn("bucket", F.explode(F.array(bucket, F.lit("all"))))
    means = both.groupBy(*keys, "bucket").agg(F.count("*").alias("sample"), F.round(F.avg("breadth"), 2).alias("mean_breadth"), F.round(F.avg("core"), 4).alias("mean_core"), above("breadth", 50).alias("breadth_above_50"), above("core", 0).alias("core_positive"))
    side = lambda b, c: F.max(F.when(F.col("bucket") == b, F.col(c)))
    gap = lambda c, n: F.round(side("high", c) - side("low", c), n)
    ends = means.groupBy(*keys).agg(gap("mean_breadth", 2).alias("breadth_difference"), gap("mean_core", 4).alias("core_difference"), F.least(F.coalesce(side("high", "sample"), F.lit(0)), F.coalesce(side("low", "sample"), F.lit(0))).alias("_n"))
    x, y = F.col("breadth_difference"), F.col("core_difference")
    no = lambda c: c.isNull()
    kind = F.when(F.col("_n") < least, "insufficient_samples").when(no(x) & no(y), "insufficient_outcomes").when((no(x) | (x >= 0)) & (no(y) | (y >= 0)), "positive").when((no(x) | (x <= 0)) & (no(y) | (y <= 0)), "inverse").otherwise("mixed")
    rho = [spearman(df, "value", c, keys).select(*keys, F.col("rho").alias(f"rho_{c}")) for c in ("breadth", "core")]
    whole = ends.withColumn("relationship", kind).drop("_n").join(rho[0], keys, "left").join(rho[1], keys, "left").withColumn("bucket", F.lit("all"))
    return means.join(whole, [*keys, "bucket"], "left")


def calibration_summary(stages: DataFrame, raw: DataFrame, requested: int = 250) -> DataFrame:
    """By stage its days and scores; beside them, over all: days requested, processed (of raw) and ready (of stages), whether the baseline
    is complete, and the lowest, highest and mean score."""
    own = stages.groupBy("stage").agg(F.count("*").alias("days"), F.min("short_score").alias("low"), F.max("short_score").alias("high"), F.round(F.avg("short_score"), 6).alias("mean"))
    all_ = stages.agg(F.count("*").alias("ready"), F.min("short_score").alias("score_min"), F.max("short_score").alias("score_max"), F.round(F.avg("short_score"), 2).alias("score_mean")).crossJoin(raw.agg(F.count("*").alias("processed")))
    all_ = all_.withColumns({"requested": F.lit(requested).cast("long"), "baseline_complete": (F.col("processed") >= requested) & (F.col("ready") >= requested)})
    return own.crossJoin(F.broadcast(all_))  # one row


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Rank correlation of the pairs that aren't null, ties at mid-rank; null below three pairs or without variance."""
    df = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())

    def mid(c: str) -> Column:
        return F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, c)) - 1) / 2

    df = df.withColumns({"_x": mid(x), "_y": mid(y)})
    n, sx, sy = F.count("*"), F.sum("_x"), F.sum("_y")
    top = n * F.sum(F.col("_x") * F.col("_y")) - sx * sy
    vx, vy = n * F.sum(F.col("_x") * F.col("_x")) - sx * sx, n * F.sum(F.col("_y") * F.col("_y")) - sy * sy
    return df.groupBy(*by).agg(n.alias("n"), F.when((n >= 3) & (vx > 0) & (vy > 0), F.round(top / (F.sqrt(vx) * F.sqrt(vy)), 6)).alias("rho"))


def limit_up_evidence(bars: DataFrame, events: DataFrame, boards: DataFrame, flow: DataFrame, members: DataFrame, heat: DataFrame, announcements: DataFrame, k: int = 3) -> DataFrame:
    """One row for each limit-up: board count, the day's bar and flow, its k hottest concepts, and at most k announcements of the three days to it."""
    ups = events.filter("event_type = 'limit_up'").groupBy(*KEY).agg(F.min("open_count").alias("open_count"))
    hot = membership_asof(ups, members).join(heat.filter("heat_rank is not null").select("trade_date", "sector_code", "heat_rank"), ["trade_date", "sector_code"])
    hot = hot.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY).orderBy("heat_rank", "sector_code"))).filter(F.col("_n") <= k)
    concepts = hot.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("heat_rank", "sector_code"))), lambda x: x["sector_code"]), ",").alias("concepts"), F.min("heat_rank").alias("best_rank"))
    a = announcements.select(F.col("stock_code").alias("_c"), "published", "doc_id")
    said = ups.join(a, (F.col("stock_code") == F.col("_c")) & F.col("published").between(F.date_sub("trade_date", 3), F.col("trade_date")))
    said = said.withColumn("_n", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("published"), "doc_id"))).filter(F.col("_n") <= k).groupBy(*KEY).agg(F.count("*").alias("announcements"))
    df = ups.join(boards.select(*KEY, "board_count"), KEY, "left").join(bars.select(*KEY, "close_price", "change_pct"), KEY, "left").join(flow.select(*KEY, "main_net_inflow"), KEY, "left").join(concepts, KEY, "left").join(said, KEY, "left")
    return df.select(*KEY, "open_count", "board_count", "close_price", "change_pct", "main_net_inflow", "concepts", "best_rank", F.coalesce("announcements", F.lit(0)).cast("long").alias("announcements"))


def daily_review(sentiment_: DataFrame, heat: DataFrame, evidence: DataFrame) -> DataFrame:
    """By day: what is there, and why the review isn't ready where it isn't."""
    h = heat.filter("heat is not null").groupBy("trade_date").agg(F.count("*").alias("concepts"))
    e = evidence.groupBy("trade_date").agg(F.count("*").alias("limit_ups"))
    df = sentiment_.join(h, "trade_date", "left").join(e, "trade_date", "left")
    why = F.array_compact(F.array(F.when(F.col("status") != "ready", "sentiment_pending"), F.when(F.col("concepts").isNull(), "heat_missing"), F.when(F.col("limit_ups").isNull(), "evidence_missing")))
    return df.select("trade_date", F.coalesce("concepts", F.lit(0)).alias("concepts"), F.coalesce("limit_ups", F.lit(0)).alias("limit_ups"), (F.size(why) == 0).alias("ready"), F.array_join(why, ",").alias("reasons"))


def limit_ladder(events: DataFrame, boards: DataFrame, cap: int = 20) -> DataFrame:
    """By day and board height: how many stocks, the first of them by time of their limit (nulls last), whether more were cut off, and the day's seal rate."""
    rate = limit_counts(events).select("trade_date", F.round(ratio("limit_up_count", F.col("limit_up_count") + F.col("limit_break_count")), 6).alias("seal_rate"))
    ups = events.filter("event_type = 'limit_up'").join(boards.select(*KEY, "board_count"), KEY)
    placed = F.row_number().over(Window.partitionBy("trade_date", "board_count").orderBy(F.asc_nulls_last("first_time"), "stock_code"))
    df = ups.withColumn("_n", placed).groupBy("trade_date", "board_count").agg(F.count("*").alias("stocks"), F.array_sort(F.collect_list(F.when(F.col("_n") <= cap, F.struct("_n", "stock_code")))).alias("_l"))
    return df.join(rate, "trade_date").select("trade_date", "board_count", "stocks", (F.col("stocks") > cap).alias("truncated"), F.array_join(F.transform("_l", lambda x: x["stock_code"]), ",").alias("codes"), "seal_rate")
