"""Factor operators: daily, adjusted daily, fund, index, minute and sector factors, and what reads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import windows as W

KEY = ["stock_code", "trade_date"]


def daily_factors(bars: DataFrame) -> DataFrame:
    """Unadjusted daily factors of each bar; missing lists the windows that history doesn't fill. One exchange, one sort."""
    df = bars.withColumn("_prev", F.coalesce("pre_close_price", W.lag_k("close_price", 1)))
    df = df.withColumn("return_1d", (F.col("close_price") / F.when(F.col("_prev") != 0, F.col("_prev")) - 1) * 100)
    span = F.col("high_price") - F.col("low_price")
    base = F.coalesce("pre_close_price", "close_price")
    widths = (5, 10, 20, 30, 60)
    df = W.moving_means(df, "close_price", widths).withColumns({
        **{f"ma{n}": F.round(f"mean_{n}", 6) for n in widths},
        "amplitude": span / F.when(base != 0, base) * 100,
        "volume_ratio": F.round(F.col("volume_hand") / F.when(W.prior_mean("volume_hand") != 0, W.prior_mean("volume_hand")), 6),
        "amount_ratio": F.round(F.col("amount_yuan") / F.when(W.prior_mean("amount_yuan") != 0, W.prior_mean("amount_yuan")), 6),
        "volatility_20d": F.round(W.rolling_std("return_1d", 20), 6),
        "close_position": (F.col("close_price") - F.col("low_price")) / F.when(span != 0, span),
        "history_days": W.history_days().cast("long"),
    })
    missing = F.concat_ws(",", *[F.when(F.col("history_days") < n, name) for name, n in (("ma5", 5), ("ma10", 10), ("ma20", 20), ("ma30", 30), ("ma60", 60), ("volatility_20d", 21))])
    return df.select(*KEY, "return_1d", "ma5", "ma10", "ma20", "ma30", "ma60", "amplitude", "volume_ratio", "amount_ratio", "volatility_20d", "close_position", "history_days", missing.alias("missing"))


def fund_factors(flow: DataFrame, bars: DataFrame) -> DataFrame:
    """Flow against amount, sums over 3, 5 and 10 days, days in a row with inflow, and the day's cross-section percentile."""
    df = bars.select(*KEY, "amount_yuan").join(flow, KEY, "left")
    amount = F.when(F.col("amount_yuan") != 0, F.col("amount_yuan"))
    df = df.withColumns({
        "available": F.col("main_net_inflow").isNotNull(),
        "net_ratio": F.col("main_net_inflow") / amount * 100, "big_ratio": F.col("big_order_net_inflow") / amount * 100, "super_ratio": F.col("super_large_net_inflow") / amount * 100,
        **{f"inflow_{n}d": F.round(W.rolling_sum("main_net_inflow", n), 2) for n in (3, 5, 10)}, "flow_days_10": W.rolling_count("main_net_inflow", 10),
    })
    df = W.streak(df, F.col("main_net_inflow") > 0, "inflow_streak")
    return df.withColumn("inflow_percentile", W.cume_pct("net_ratio")).select(*KEY, "available", "net_ratio", "big_ratio", "super_ratio", "inflow_3d", "inflow_5d", "inflow_10d", "flow_days_10", "inflow_streak", F.round("inflow_percentile", 6).alias("inflow_percentile"))


def daily_factors_v2(bars: DataFrame, adjust: DataFrame, basic: DataFrame, flow: DataFrame, technical: DataFrame | None = None) -> DataFrame:
    """Forward-adjusted factors. Prices are scaled by the factor (1 where there is none); returns need both days' factors;
    means and extremes go back to the day's own price and need every row of their window to have a factor.
    A vendor's value of `technical` (same names, ma5 and so on) goes before the local one. status is ready if nothing is missing."""
    df = bars.join(adjust, KEY, "left").withColumn("factor", F.coalesce("adj_factor", F.lit(1.0)))
    df = df.withColumns({f"s_{c}": F.col(f"{c}_price") * F.col("factor") for c in ("close", "high", "low")})
    ok = F.col("adj_factor")
    returns = {f"return_{k}d": F.when(ok.isNotNull() & W.lag_k("adj_factor", k).isNotNull(), (F.col("s_close") / W.lag_k("s_close", k) - 1) * 100) for k in (1, 3, 5, 10, 20)}
    df = df.withColumns(returns | {"_delta": F.col("s_close") - W.lag_k("s_close", 1), "history_days": W.history_days().cast("long"), "fallback": ok.isNull()})
    widths = (5, 10, 20, 30, 60, 90, 250)
    df = W.moving_means(df, "s_close", widths)
    ma = {f"ma{n}": W.guarded(F.round(F.col(f"mean_{n}") / F.col("factor"), 6), ok, n) for n in widths}
    high = {f"high_{n}d": W.guarded(W.rolling_extreme("s_high", n, "max") / F.col("factor"), ok, n) for n in (20, 60)}
    low = {f"low_{n}d": W.guarded(W.rolling_extreme("s_low", n, "min") / F.col("factor"), ok, n) for n in (20, 60)}
    df = df.withColumns(ma | high | low | {
        "rsi14": F.round(W.rsi_simple(F.col("_delta"), 14), 6), "volatility_20d": F.round(W.rolling_std("return_1d", 20), 6),
        "volume_ratio_5d": F.round(F.col("volume_hand") / F.when(W.prior_mean("volume_hand") != 0, W.prior_mean("volume_hand")), 6),
    })
    df = df.withColumn("drawdown_60d", (F.col("close_price") / F.col("high_60d") - 1) * 100)
    df = df.join(basic.select(*KEY, "turnover_rate"), KEY, "left").join(flow.select(*KEY, "main_net_inflow"), KEY, "left")
    names = list(ma)
    if technical is not None:
        vendor = technical.select(*KEY, *[F.col(n).alias(f"v_{n}") for n in names])
        df = df.join(vendor, KEY, "left").withColumns({n: F.coalesce(f"v_{n}", n) for n in names})
    needs = [*returns, *ma, *high, *low, "drawdown_60d", "rsi14", "volatility_20d", "turnover_rate", "main_net_inflow"]
    missing = F.array_compact(F.array(*[F.when(F.col(n).isNull(), n) for n in needs]))
    df = df.withColumn("net_ratio", F.col("main_net_inflow") / F.when(F.col("amount_yuan") != 0, F.col("amount_yuan")) * 100)
    return df.select(*KEY, *needs, "volume_ratio_5d", "net_ratio", "history_days", "fallback", F.array_join(missing, ",").alias("missing"), F.when(F.size(missing) == 0, "ready").otherwise("partial").alias("status"))


def index_factors(bars: DataFrame) -> DataFrame:
    """The shape of daily_factors on index bars (index_code)."""
    return daily_factors(bars.withColumnRenamed("index_code", "stock_code")).withColumnRenamed("stock_code", "index_code")


def minute_factors(minutes: DataFrame, tie: str = "event_id") -> DataFrame:
    """Within a stock's day, row by row: volume-weighted price over rows with volume, return since the first price, spike against
    the 20 rows before (only once there are 20 with volume), and the place within the range so far."""
    w = W.by(*KEY, order=["bar_time", tie])
    has = F.col("volume_hand") > 0
    amount = W.running(F.when(has, F.col("amount_yuan")), "sum", w)
    volume = W.running(F.when(has, F.col("volume_hand")), "sum", w)
    mean, count = W.prior_stats("volume_hand", 20, w)
    first = F.first("price").over(w.rowsBetween(Window.unboundedPreceding, 0))
    top, bottom = W.running("price", "max", w), W.running("price", "min", w)
    return minutes.select(
        *KEY, "bar_time", tie, F.round(amount / (F.when(volume != 0, volume) * 100), 6).alias("vwap"), ((F.col("price") / first - 1) * 100).alias("return_pct"),
        F.round(F.when(count == 20, F.col("volume_hand") / mean), 6).alias("volume_spike"),
        ((F.col("price") - bottom) / F.when(top != bottom, top - bottom)).alias("intraday_strength"),
    )


def technical_snapshot(bars: DataFrame, factors: DataFrame, minutes: DataFrame) -> DataFrame:
    """One row a stock and day: strength from the last minute within the whole day's range, else from change; volume score; trend score."""
    last = minutes.groupBy(*KEY).agg(F.max_by("price", F.struct("bar_time", "event_id")).alias("last"), F.max("price").alias("top"), F.min("price").alias("bottom"))
    last = last.withColumn("strength", (F.col("last") - F.col("bottom")) / F.when(F.col("top") != F.col("bottom"), F.col("top") - F.col("bottom")) * 100)
    df = bars.select(*KEY, "close_price", "change_pct").join(factors.select(*KEY, "ma5", "ma10", "ma20", "volume_ratio"), KEY, "left").join(last.select(*KEY, "strength"), KEY, "left")
    c = F.col("close_price")
    trend = F.lit(50) + F.when(c > F.col("ma5"), 20).otherwise(0) + F.when(F.col("ma5") > F.col("ma10"), 20).otherwise(0) + F.when(F.col("ma10") > F.col("ma20"), 10).otherwise(0)
    return df.select(*KEY, F.coalesce("strength", "change_pct").alias("strength"), F.least(F.col("volume_ratio") * 20, F.lit(100.0)).alias("volume_score"), F.least(trend, F.lit(100)).cast("long").alias("trend_score"))


def chip_features(chips: DataFrame, bars: DataFrame) -> DataFrame:
    """Widths of cost bands, close against the mean cost, and concentration, from cost_5 to cost_95 and weight_avg."""
    mid = F.when(F.col("cost_50") != 0, F.col("cost_50"))
    width = (F.col("cost_85") - F.col("cost_15")) / mid * 100
    return chips.join(bars.select(*KEY, "close_price"), KEY).select(
        *KEY, ((F.col("cost_95") - F.col("cost_5")) / mid * 100).alias("width_90"), width.alias("width_70"),
        ((F.col("close_price") / F.when(F.col("weight_avg") != 0, F.col("weight_avg")) - 1) * 100).alias("close_vs_cost"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - width)).alias("concentration"),
    )


def member_spans(members: DataFrame) -> DataFrame:
    """members with spans of a stock and sector that overlap made one; open bounds are null. No day lies in two of them."""
    w = Window.partitionBy("stock_code", "sector_code").orderBy(F.asc_nulls_first("start_date"))
    end = F.coalesce("end_date", F.lit("9999-12-31").cast("date"))
    reached = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = members.withColumn("_apart", F.when(reached.isNull() | F.coalesce(F.col("start_date") > reached, F.lit(False)), 1).otherwise(0))
    df = df.withColumn("_span", W.running("_apart", "sum", w.orderBy(F.asc_nulls_first("start_date"), F.desc("_apart"))))
    bound = lambda c, fn: F.when(F.count_if(F.col(c).isNull()) == 0, fn(c)).alias(c)
    return df.groupBy("stock_code", "sector_code", "_span").agg(bound("start_date", F.min), bound("end_date", F.max)).drop("_span")


def membership_asof(facts: DataFrame, members: DataFrame) -> DataFrame:
    """facts with the sectors that each stock is a member of on its day; open bounds are null. Each row of facts meets a sector at most
    once, as members' spans are made disjoint first: facts by sectors, the large side, are neither shuffled nor made distinct."""
    inside = (F.col("start_date").isNull() | (F.col("start_date") <= F.col("trade_date"))) & (F.col("end_date").isNull() | (F.col("trade_date") <= F.col("end_date")))
    m = member_spans(members).withColumnRenamed("stock_code", "_c")
    return facts.join(m, (F.col("stock_code") == F.col("_c")) & inside).drop("_c", "start_date", "end_date")


def sector_factors(bars: DataFrame, flow: DataFrame, events: DataFrame, members: DataFrame) -> DataFrame:
    """Factors of each sector and day with members' bars: flow and its percentile, sums and streak, breadth, volatility of the
    mean change (from two days on), volume anomaly against the five days before, and tags."""
    ups = events.filter("event_type = 'limit_up'").select(*KEY, F.lit(1).alias("up")).distinct()
    rows = membership_asof(bars.join(flow.select(*KEY, "main_net_inflow"), KEY, "left").join(ups, KEY, "left"), members)
    df = rows.groupBy("sector_code", "trade_date").agg(
        F.sum(F.col("main_net_inflow").cast("decimal(20,2)")).cast("double").alias("net_inflow"), F.count_if(F.col("change_pct") > 0).alias("rising"), F.count("up").alias("limit_ups"), F.count("*").alias("members"),
        F.round(F.avg("change_pct"), 6).alias("mean_change"), F.sum("volume_hand").alias("volume"), F.count_if(F.col("main_net_inflow") > 0).alias("inflow_members"),
    )
    w = W.by("sector_code")
    df = df.withColumns({
        **{f"flow_{n}d": F.round(W.rolling_sum("net_inflow", n, w), 2) for n in (3, 5, 10)},
        "volatility_20d": F.when(W.rolling_count("mean_change", 20, w) >= 2, F.round(W.rolling_std("mean_change", 20, w), 8)),
        "volume_anomaly": F.round(F.col("volume") / F.when(W.prior_mean("volume", 5, w) != 0, W.prior_mean("volume", 5, w)), 6), "inflow_share": F.col("inflow_members") / F.col("members") * 100,
    })
    df = W.streak(df, F.col("net_inflow") > 0, "inflow_streak", ("sector_code",)).withColumn("fund_strength", F.round(W.cume_pct("net_inflow"), 6))
    tags = F.concat_ws(",", F.when((F.col("volume_anomaly") >= 1.5) & (F.col("mean_change") > 0), "放量异动"), F.when((F.col("mean_change") >= 2) | (F.col("fund_strength") >= 80), "强度异动"), F.when(F.col("inflow_streak") >= 3, "持续流入"), F.when((F.col("net_inflow") > 0) & (F.col("mean_change") < 0), "逆势异动"))
    return df.withColumn("tags", tags).drop("volume", "inflow_members")


def select_technical(technical: DataFrame, names: list[str]) -> DataFrame:
    """The named vendor factors that aren't null, as a map."""
    pairs: list[Column] = [x for n in names for x in (F.lit(n), F.col(n).cast("double"))]
    return technical.select(*KEY, F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()).alias("factors"))


def compare_factor_sets(v1: DataFrame, v2: DataFrame, bars: DataFrame) -> DataFrame:
    """By day: coverage of the second set, its rows without a factor, and mean absolute differences of two means."""
    df = bars.select(*KEY).join(v1.select(*KEY, F.col("ma5").alias("a5"), F.col("ma20").alias("a20")), KEY, "left").join(v2.select(*KEY, F.col("ma5").alias("b5"), F.col("ma20").alias("b20"), "fallback"), KEY, "left")
    return df.groupBy("trade_date").agg(
        F.count("*").alias("bar_count"), F.count("fallback").alias("v2_count"), F.count_if(F.col("fallback")).alias("fallback_count"),
        F.round(F.avg(F.abs(F.col("a5") - F.col("b5"))), 6).alias("ma5_diff"), F.round(F.avg(F.abs(F.col("a20") - F.col("b20"))), 6).alias("ma20_diff"),
    ).withColumn("coverage", F.col("v2_count") / F.col("bar_count"))


def activation_gate(validation: DataFrame, days: int = 5, least: float = 0.98) -> DataFrame:
    """One row: whether each of the latest days has enough coverage and no row without a factor."""
    last = validation.orderBy(F.desc("trade_date")).limit(days)
    ok = (F.col("coverage") >= least) & (F.col("fallback_count") == 0)
    return last.agg(F.count("*").alias("days"), F.count_if(ok).alias("good_days")).withColumn("active", (F.col("days") == days) & (F.col("good_days") == days))


def active_factors(v1: DataFrame, v2: DataFrame, registry: DataFrame) -> DataFrame:
    """The rows of the versions that the registry (version, is_active) has active."""
    both = v1.withColumn("version", F.lit("v1")).unionByName(v2.withColumn("version", F.lit("v2")), allowMissingColumns=True)
    return both.join(F.broadcast(registry.filter("is_active").select("version").distinct()), "version", "left_semi")
