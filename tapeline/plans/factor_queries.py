"""Registered queries over factors and windows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import windows as W
from ..operators import factors as X
from ..sources import domain as D
from .oracle import with_frames

_W = "over (partition by stock_code order by trade_date"
_PREV5 = f"avg({{c}}) {_W} rows between 5 preceding and 1 preceding)"


def _ma(c: str, n: int) -> str:
    return f"avg({c}) {_W} rows between {n - 1} preceding and current row)"


F1 = f"""
select stock_code, trade_date, return_1d, round({_ma('close_price', 5)}, 6) as ma5, round({_ma('close_price', 10)}, 6) as ma10, round({_ma('close_price', 20)}, 6) as ma20, round({_ma('close_price', 30)}, 6) as ma30, round({_ma('close_price', 60)}, 6) as ma60,
  (high_price - low_price) / coalesce(pre_close_price, close_price) * 100 as amplitude, round(volume_hand / {_PREV5.format(c='volume_hand')}, 6) as volume_ratio, round(amount_yuan / {_PREV5.format(c='amount_yuan')}, 6) as amount_ratio,
  round(stddev_pop(return_1d) {_W} rows between 19 preceding and current row), 6) as volatility_20d, (close_price - low_price) / nullif(high_price - low_price, 0) as close_position, h as history_days,
  concat_ws(',', case when h < 5 then 'ma5' end, case when h < 10 then 'ma10' end, case when h < 20 then 'ma20' end, case when h < 30 then 'ma30' end, case when h < 60 then 'ma60' end, case when h < 21 then 'volatility_20d' end) as missing
from (select *, (close_price / pre_close_price - 1) * 100 as return_1d, row_number() {_W}) as h from bars)"""

F2 = f"""
select stock_code, trade_date, available, net_ratio, big_ratio, super_ratio, inflow_3d, inflow_5d, inflow_10d, flow_days_10, cast(case when up then sum(case when up then 1 else 0 end) over (partition by stock_code, island order by trade_date) else 0 end as bigint) as inflow_streak,
  round(case when net_ratio is not null then cume_dist() over (partition by trade_date, net_ratio is null order by net_ratio) * 100 end, 6) as inflow_percentile
from (select *, sum(case when up then 0 else 1 end) {_W}) as island from (
  select b.stock_code, b.trade_date, main_net_inflow is not null as available, main_net_inflow / amount_yuan * 100 as net_ratio, big_order_net_inflow / amount_yuan * 100 as big_ratio, super_large_net_inflow / amount_yuan * 100 as super_ratio,
    {', '.join(f"round(sum(main_net_inflow) over (partition by b.stock_code order by b.trade_date rows between {n - 1} preceding and current row), 2) as inflow_{n}d" for n in (3, 5, 10))},
    count(main_net_inflow) over (partition by b.stock_code order by b.trade_date rows between 9 preceding and current row) as flow_days_10, coalesce(main_net_inflow > 0, false) as up
  from bars b left join flow f on b.stock_code = f.stock_code and b.trade_date = f.trade_date))"""


def _guard(n: int, e: str) -> str:
    return f"case when count(adj_factor) {_W} rows between {n - 1} preceding and current row) = least(h, {n}) then {e} end"


_RET = ", ".join(f"case when adj_factor is not null and lag(adj_factor, {k}) {_W}) is not null then (s_close / lag(s_close, {k}) {_W}) - 1) * 100 end as return_{k}d" for k in (1, 3, 5, 10, 20))
_MA2 = ", ".join(f"{_guard(n, 'round(' + _ma('s_close', n) + ' / factor, 6)')} as ma{n}" for n in (5, 10, 20, 30, 60, 90, 250))
_EXT = ", ".join(f"{_guard(n, f'{fn}(s_{c}) {_W} rows between {n - 1} preceding and current row) / factor')} as {c}_{n}d" for c, fn in (("high", "max"), ("low", "min")) for n in (20, 60))
_NEEDS = [f"return_{k}d" for k in (1, 3, 5, 10, 20)] + [f"ma{n}" for n in (5, 10, 20, 30, 60, 90, 250)] + ["high_20d", "high_60d", "low_20d", "low_60d", "drawdown_60d", "rsi14", "volatility_20d", "turnover_rate", "main_net_inflow"]
F5 = f"""
select stock_code, trade_date, {', '.join(_NEEDS)}, volume_ratio_5d, main_net_inflow / amount_yuan * 100 as net_ratio, history_days, fallback, missing, case when missing = '' then 'ready' else 'partial' end as status
from (select *, concat_ws(',', {', '.join(f"case when {n} is null then '{n}' end" for n in _NEEDS)}) as missing from (
  select z.*, (close_price / high_60d - 1) * 100 as drawdown_60d, t.turnover_rate, f.main_net_inflow from (
    select *, {_MA2}, {_EXT}, round(case when loss = 0 and gain > 0 then 100 when loss > 0 then 100 - 100 / (1 + gain / loss) end, 6) as rsi14, round(stddev_pop(return_1d) {_W} rows between 19 preceding and current row), 6) as volatility_20d,
      round(volume_hand / {_PREV5.format(c='volume_hand')}, 6) as volume_ratio_5d, h as history_days, adj_factor is null as fallback
    from (select *, avg(greatest(delta, 0)) {_W} rows between 13 preceding and current row) as gain, avg(greatest(-delta, 0)) {_W} rows between 13 preceding and current row) as loss from (
      select *, {_RET}, s_close - lag(s_close) {_W}) as delta, row_number() {_W}) as h from (
        select b.*, a.adj_factor, coalesce(a.adj_factor, 1) as factor, close_price * coalesce(a.adj_factor, 1) as s_close, high_price * coalesce(a.adj_factor, 1) as s_high, low_price * coalesce(a.adj_factor, 1) as s_low
        from bars b left join adjust a on a.stock_code = b.stock_code and a.trade_date = b.trade_date)))) z
  left join basic t on t.stock_code = z.stock_code and t.trade_date = z.trade_date left join flow f on f.stock_code = z.stock_code and f.trade_date = z.trade_date))"""

_D = "over (partition by stock_code, trade_date order by bar_time, event_id"
F8 = f"""
select stock_code, trade_date, bar_time, event_id, round(a / (nullif(v, 0) * 100), 6) as vwap, (price / first_price - 1) * 100 as return_pct, round(case when n = 20 then volume_hand / m end, 6) as volume_spike, (price - lo) / nullif(hi - lo, 0) as intraday_strength
from (select *, sum(case when volume_hand > 0 then amount_yuan end) {_D}) as a, sum(case when volume_hand > 0 then volume_hand end) {_D}) as v, first(price) {_D}) as first_price, max(price) {_D}) as hi, min(price) {_D}) as lo,
  avg(case when volume_hand > 0 then volume_hand end) {_D} rows between 20 preceding and 1 preceding) as m, count(case when volume_hand > 0 then 1 end) {_D} rows between 20 preceding and 1 preceding) as n from minutes)"""

ASOF = "select f.*, sector_code from bars f join members m on f.stock_code = m.stock_code and (start_date is null or start_date <= trade_date) and (end_date is null or trade_date <= end_date)"

F6 = """
select sector_code, trade_date, net_inflow, rising, limit_ups, members, mean_change, flow_3d, flow_5d, flow_10d, volatility_20d, volume_anomaly, inflow_share, inflow_streak, fund_strength,
  concat_ws(',', case when volume_anomaly >= 1.5 and mean_change > 0 then '放量异动' end, case when mean_change >= 2 or fund_strength >= 80 then '强度异动' end, case when inflow_streak >= 3 then '持续流入' end, case when net_inflow > 0 and mean_change < 0 then '逆势异动' end) as tags
from (select *, cast(case when up then sum(case when up then 1 else 0 end) over (partition by sector_code, island order by trade_date) else 0 end as bigint) as inflow_streak,
    round(case when net_inflow is not null then cume_dist() over (partition by trade_date, net_inflow is null order by net_inflow) * 100 end, 6) as fund_strength from (
  select *, round(sum(net_inflow) over (w rows between 2 preceding and current row), 2) as flow_3d, round(sum(net_inflow) over (w rows between 4 preceding and current row), 2) as flow_5d, round(sum(net_inflow) over (w rows between 9 preceding and current row), 2) as flow_10d,
    case when count(mean_change) over (w rows between 19 preceding and current row) >= 2 then round(stddev_pop(mean_change) over (w rows between 19 preceding and current row), 8) end as volatility_20d,
    round(volume / nullif(avg(volume) over (w rows between 5 preceding and 1 preceding), 0), 6) as volume_anomaly, inflow_members / members * 100 as inflow_share, coalesce(net_inflow > 0, false) as up, sum(case when coalesce(net_inflow > 0, false) then 0 else 1 end) over (w) as island
  from (select sector_code, b.trade_date, cast(sum(cast(main_net_inflow as decimal(20,2))) as double) as net_inflow, count(*) filter (change_pct > 0) as rising, count(up) as limit_ups, count(*) as members, round(avg(change_pct), 6) as mean_change, sum(volume_hand) as volume, count(*) filter (main_net_inflow > 0) as inflow_members
    from member_bars b left join flow f on f.stock_code = b.stock_code and f.trade_date = b.trade_date left join (select distinct stock_code, trade_date, 1 as up from limit_events where event_type = 'limit_up') u on u.stock_code = b.stock_code and u.trade_date = b.trade_date group by 1, 2)
  window w as (partition by sector_code order by trade_date)))"""


def _frames(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [getattr(D, n)(spark, d) for n in names]


def index_bars(spark: SparkSession, d: str) -> DataFrame:
    """Indexes: the mean prices of each region's stocks by day."""
    b = D.bars(spark, d).join(F.broadcast(D.stocks(spark, d).select("stock_code", "region_key")), "stock_code")
    df = b.groupBy(F.concat(F.lit("IDX"), F.col("region_key")).alias("index_code"), "trade_date").agg(*[(F.sum(F.col(c).cast("decimal(18,8)")).cast("double") / F.count("*")).alias(c) for c in ("open_price", "high_price", "low_price", "close_price")], F.sum("volume_hand").alias("volume_hand"), F.sum(F.col("amount_yuan").cast("decimal(18,2)")).cast("double").alias("amount_yuan"))
    return df.withColumn("pre_close_price", F.lag("close_price").over(W.by("index_code")))


INDEX = """
select *, lag(close_price) over (partition by index_code order by trade_date) as pre_close_price from (
  select 'IDX' || region_key as index_code, trade_date, cast(sum(cast(open_price as decimal(18,8))) as double) / count(*) as open_price, cast(sum(cast(high_price as decimal(18,8))) as double) / count(*) as high_price, cast(sum(cast(low_price as decimal(18,8))) as double) / count(*) as low_price, cast(sum(cast(close_price as decimal(18,8))) as double) / count(*) as close_price, cast(sum(volume_hand) as bigint) as volume_hand, cast(sum(cast(amount_yuan as decimal(18,2))) as double) as amount_yuan
  from bars b join stocks s on s.stock_code = b.stock_code group by 1, 2)"""


def f01(spark, d):
    return X.daily_factors(D.bars(spark, d))


def f02(spark, d):
    return X.fund_factors(*_frames(spark, d, "flow", "bars"))


def f05(spark, d):
    return X.daily_factors_v2(*_frames(spark, d, "bars", "adjust", "basic", "flow"))


def f06(spark, d):
    return X.sector_factors(*_frames(spark, d, "bars", "flow", "limit_events", "members"))


def f07(spark, d):
    return X.index_factors(index_bars(spark, d))


def f08(spark, d):
    return X.minute_factors(D.minutes(spark, d))


def f03(spark, d):
    names = ["ma5", "ma250", "rsi14", "high_60d"]
    found = X.select_technical(f05(spark, d).select("stock_code", "trade_date", *names), names)
    return found.select("stock_code", "trade_date", F.size("factors").cast("long").alias("n_factors"), F.array_join(F.array_sort(F.map_keys("factors")), ",").alias("names"))


def f04(spark, d):
    b = D.bars(spark, d)
    q = lambda k: F.col("low_price") + (F.col("high_price") - F.col("low_price")) * (k / 100)
    chips = b.select("stock_code", "trade_date", *[q(k).alias(f"cost_{k}") for k in (5, 15, 50, 85, 95)], ((F.col("high_price") + F.col("low_price")) / 2).alias("weight_avg"))
    return X.chip_features(chips, b)


def f09(spark, d):
    return X.technical_snapshot(D.bars(spark, d), f01(spark, d), D.minutes(spark, d))


def f10(spark, d):
    """Backfill of all days: those whose factors aren't there are computed in one job over their history."""
    target = D.bars(spark, d)
    ready = f01(spark, d).filter("stock_code <= '000050' and history_days % 2 = 0").select("stock_code", "trade_date")
    todo = target.select("stock_code", "trade_date").join(ready, ["stock_code", "trade_date"], "left_anti")
    return f01(spark, d).join(todo, ["stock_code", "trade_date"], "left_semi").select("stock_code", "trade_date", "ma20", "return_1d")


def a20(spark, d):
    return X.compare_factor_sets(f01(spark, d), f05(spark, d), D.bars(spark, d))


def f11(spark, d):
    return X.activation_gate(a20(spark, d))


def p16(spark, d):
    registry = spark.createDataFrame([("v1", False), ("v2", True)], "version string, is_active boolean")
    return X.active_factors(f01(spark, d).select("stock_code", "trade_date", "ma5", "ma20"), f05(spark, d).select("stock_code", "trade_date", "ma5", "ma20"), registry)


# ---- one query for each window helper ------------------------------------------------------------------------------


def _w(expr):
    return lambda spark, d: D.bars(spark, d).select("stock_code", "trade_date", *expr())


def w09(spark, d):
    return W.streak(D.bars(spark, d), F.col("change_pct") > 0, "up_streak").select("stock_code", "trade_date", "up_streak")


def _per_day(spark, d):
    return D.bars(spark, d).groupBy("trade_date").agg(F.count_if(F.col("change_pct") > 0).cast("double").alias("up"), F.sum(F.col("amount_yuan").cast("decimal(18,2)")).cast("double").alias("amount"))


def w15(spark, d):
    return W.history_percentile(_per_day(spark, d).withColumn("metric", F.lit("up")), ["metric"], "trade_date", "up", 120, F.col("metric") == "none").select("trade_date", "up", "sample", "percentile")


def w16(spark, d):
    return D.bars(spark, d).select("stock_code", "trade_date", W.avg_rank_pct("volume_hand").alias("place"))


def ups(spark, d):
    return D.limit_events(spark, d).filter("event_type = 'limit_up'").select("stock_code", "trade_date").distinct()


def w17(spark, d):
    return W.calendar_streak(ups(spark, d), D.calendar(spark, d))


def w18(spark, d):
    q = D.quotes(spark, d)
    return W.rank_with_delta(q, [F.desc("change_pct"), F.col("stock_code")], "round_time", "stock_code").select("stock_code", "round_time", "rank", "rank_change")


def w19(spark, d):
    q = D.quotes(spark, d).groupBy("round_time").agg((F.count_if(F.col("change_pct") > 0) * 100 / F.count("*")).alias("p")).withColumn("state", F.when(F.col("p") >= 65, "broad").when(F.col("p") <= 35, "weak").otherwise("mixed")).withColumn("k", F.lit("all"))
    return W.change_points(q, ["k"], "round_time", "state").select("round_time", "state", "previous_state")


def w20(spark, d):
    df = D.bars(spark, d).withColumns({"ma5": F.round(W.sma("close_price", 5), 6), "ma10": F.round(W.sma("close_price", 10), 6)})
    return df.withColumn("crossed", W.crossed_up("ma5", "ma10")).filter("crossed").select("stock_code", "trade_date", "ma5", "ma10")


def w21(spark, d):
    return D.bars(spark, d).select("stock_code", "trade_date", F.round(W.forward_compound("change_pct", 3, W.by("stock_code")), 6).alias("forward_3"))


def w22(spark, d):
    return W.baseline_ratio(_per_day(spark, d), "amount", 5, 3, "ratio").select("trade_date", F.round("ratio", 6).alias("ratio"))


def w23(spark, d):
    high, slope = W.recent_high_and_slope("up", Window.orderBy("trade_date"))
    return _per_day(spark, d).select("trade_date", high.alias("recent_high"), slope.alias("slope"))


_DAY = "select trade_date, cast(count(*) filter (change_pct > 0) as double) as up, cast(sum(cast(amount_yuan as decimal(18,2))) as double) as amount from bars group by 1"
_SEL = "select stock_code, trade_date, "
TABLE = {
    "f01_daily_factors": (f01, F1),
    "f02_fund_factors": (f02, F2),
    "f03_select_technical": (f03, "select stock_code, trade_date, cast((ma5 is not null)::int + (ma250 is not null)::int + (rsi14 is not null)::int + (high_60d is not null)::int as bigint) as n_factors, concat_ws(',', case when high_60d is not null then 'high_60d' end, case when ma250 is not null then 'ma250' end, case when ma5 is not null then 'ma5' end, case when rsi14 is not null then 'rsi14' end) as names from f5", {"f5": F5}),
    "f04_chip_features": (f04, """select stock_code, trade_date, (q95 - q5) / nullif(q50, 0) * 100 as width_90, (q85 - q15) / nullif(q50, 0) * 100 as width_70, (close_price / ((high_price + low_price) / 2) - 1) * 100 as close_vs_cost, greatest(0, least(100, 100 - (q85 - q15) / nullif(q50, 0) * 100)) as concentration
from (select *, low_price + (high_price - low_price) * 0.05::double as q5, low_price + (high_price - low_price) * 0.15::double as q15, low_price + (high_price - low_price) * 0.5::double as q50, low_price + (high_price - low_price) * 0.85::double as q85, low_price + (high_price - low_price) * 0.95::double as q95 from bars)"""),
    "f05_daily_factors_v2": (f05, F5),
    "f06_sector_factors": (f06, F6, {"member_bars": ASOF}),
    "f07_index_factors": (f07, F1.replace("stock_code", "index_code").replace("from bars", "from idx"), {"idx": INDEX}),
    "f08_minute_factors": (f08, F8),
    "f09_technical_snapshot": (f09, """select b.stock_code, b.trade_date, coalesce((m.last - bottom) / nullif(top - bottom, 0) * 100, change_pct) as strength, case when volume_ratio is not null then least(volume_ratio * 20, 100) else 100 end as volume_score,
  cast(least(50 + case when close_price > ma5 then 20 else 0 end + case when ma5 > ma10 then 20 else 0 end + case when ma10 > ma20 then 10 else 0 end, 100) as bigint) as trend_score
from bars b left join f1 f on f.stock_code = b.stock_code and f.trade_date = b.trade_date left join (select stock_code, trade_date, last(price order by bar_time, event_id) as last, max(price) as top, min(price) as bottom from minutes group by 1, 2) m on m.stock_code = b.stock_code and m.trade_date = b.trade_date""", {"f1": F1}),
    "f10_backfill_window": (f10, "select stock_code, trade_date, ma20, return_1d from f1 where trade_date in (select trade_date from calendar) and not (stock_code <= '000050' and history_days % 2 = 0)", {"f1": F1}),
    "f11_activation_gate": (f11, "select count(*) as days, count(*) filter (coverage >= 0.98 and fallback_count = 0) as good_days, count(*) = 5 and count(*) filter (coverage >= 0.98 and fallback_count = 0) = 5 as active from (select * from a20 order by trade_date desc limit 5)", {"f1": F1, "f5": F5, "a20": (A20 := """select b.trade_date, count(*) as bar_count, count(fallback) as v2_count, count(*) filter (fallback) as fallback_count, round(avg(abs(a.ma5 - c.ma5)), 6) as ma5_diff, round(avg(abs(a.ma20 - c.ma20)), 6) as ma20_diff, count(fallback) / count(*) as coverage
from bars b left join f1 a on a.stock_code = b.stock_code and a.trade_date = b.trade_date left join f5 c on c.stock_code = b.stock_code and c.trade_date = b.trade_date group by 1""")}),
    "a20_compare_factor_sets": (a20, A20, {"f1": F1, "f5": F5}),
    "p16_active_factors": (p16, "select stock_code, trade_date, ma5, ma20, 'v2' as version from f5", {"f5": F5}),
    "w01_trailing_means": (_w(lambda: [F.round(W.sma("close_price", n), 8).alias(f"ma{n}") for n in (5, 90, 250)]), _SEL + ", ".join(f"round({_ma('close_price', n)}, 8) as ma{n}" for n in (5, 90, 250)) + " from bars"),
    "w02_prior_mean": (_w(lambda: [F.round(W.prior_mean("volume_hand", 5), 6).alias("m")]), _SEL + f"round({_PREV5.format(c='volume_hand')}, 6) as m from bars"),
    "w03_lags": (_w(lambda: [W.lag_k("close_price", k).alias(f"lag_{k}") for k in (1, 3, 5, 10, 20)]), _SEL + ", ".join(f"lag(close_price, {k}) {_W}) as lag_{k}" for k in (1, 3, 5, 10, 20)) + " from bars"),
    "w04_rolling_std": (_w(lambda: [F.round(W.rolling_std("change_pct", 20), 6).alias("std")]), _SEL + f"round(stddev_pop(change_pct) {_W} rows between 19 preceding and current row), 6) as std from bars"),
    "w05_rolling_extremes": (_w(lambda: [W.rolling_extreme("high_price", 60).alias("hi"), W.rolling_extreme("low_price", 20, "min").alias("lo")]), _SEL + f"max(high_price) {_W} rows between 59 preceding and current row) as hi, min(low_price) {_W} rows between 19 preceding and current row) as lo from bars"),
    "w06_history_days": (_w(lambda: [W.history_days().cast("long").alias("n")]), _SEL + f"row_number() {_W}) as n from bars"),
    "w07_guarded": (lambda spark, d: D.bars(spark, d).join(D.adjust(spark, d), ["stock_code", "trade_date"], "left").select("stock_code", "trade_date", W.guarded(F.round(W.sma("close_price", 10), 6), "adj_factor", 10).alias("ma10")), _SEL + f"case when count(adj_factor) {_W} rows between 9 preceding and current row) = least(row_number() {_W}), 10) then round({_ma('close_price', 10)}, 6) end as ma10 from (select b.*, adj_factor from bars b left join adjust a on a.stock_code = b.stock_code and a.trade_date = b.trade_date)"),
    "w08_rolling_sums": (_w(lambda: [W.rolling_sum("volume_hand", n).alias(f"s{n}") for n in (3, 5, 10)]), _SEL + ", ".join(f"cast(sum(volume_hand) {_W} rows between {n - 1} preceding and current row) as bigint) as s{n}" for n in (3, 5, 10)) + " from bars"),
    "w09_streak": (w09, f"select stock_code, trade_date, cast(case when up then sum(case when up then 1 else 0 end) over (partition by stock_code, island order by trade_date) else 0 end as bigint) as up_streak from (select *, sum(case when up then 0 else 1 end) {_W}) as island from (select *, coalesce(change_pct > 0, false) as up from bars))"),
    "w10_cume_pct": (_w(lambda: [F.round(W.cume_pct("change_pct"), 6).alias("pct")]), _SEL + "round(case when change_pct is not null then cume_dist() over (partition by trade_date, change_pct is null order by change_pct) * 100 end, 6) as pct from bars"),
    "w11_rsi": (lambda spark, d: D.bars(spark, d).withColumn("delta", F.col("close_price") - F.col("pre_close_price")).select("stock_code", "trade_date", F.round(W.rsi_simple(F.col("delta")), 6).alias("rsi")), f"select stock_code, trade_date, round(case when loss = 0 and gain > 0 then 100 when loss > 0 then 100 - 100 / (1 + gain / loss) end, 6) as rsi from (select *, avg(greatest(close_price - pre_close_price, 0)) {_W} rows between 13 preceding and current row) as gain, avg(greatest(pre_close_price - close_price, 0)) {_W} rows between 13 preceding and current row) as loss from bars)"),
    "w12_running": (lambda spark, d: (lambda w: D.minutes(spark, d).select("stock_code", "bar_time", "event_id", W.running("volume_hand", "sum", w).alias("v"), W.running("price", "max", w).alias("hi"), F.first("price").over(w).alias("first")))(W.by("stock_code", "trade_date", order=["bar_time", "event_id"])), f"select stock_code, bar_time, event_id, cast(sum(volume_hand) {_D}) as bigint) as v, max(price) {_D}) as hi, first(price) {_D}) as first from minutes"),
    "w13_prior_stats": (lambda spark, d: D.minutes(spark, d).select("stock_code", "event_id", *(lambda mc: (F.round(mc[0], 6).alias("m"), mc[1].alias("n")))(W.prior_stats("volume_hand", 20, W.by("stock_code", "trade_date", order=["bar_time", "event_id"])))), f"select stock_code, event_id, round(avg(case when volume_hand > 0 then volume_hand end) {_D} rows between 20 preceding and 1 preceding), 6) as m, count(case when volume_hand > 0 then 1 end) {_D} rows between 20 preceding and 1 preceding) as n from minutes"),
    "w14_partition_agg": (lambda spark, d: D.minutes(spark, d).select("stock_code", "event_id", *[W.partition_agg("price", f, "stock_code", "trade_date").alias(f) for f in ("min", "max", "count")]), "select stock_code, event_id, min(price) over p as min, max(price) over p as max, count(price) over p as count from minutes window p as (partition by stock_code, trade_date)"),
    "w15_history_percentile": (w15, "select a.trade_date, a.up, count(b.up) as sample, (count(*) filter (b.up < a.up) + 0.5::double * count(*) filter (b.up = a.up)) / nullif(count(b.up), 0) * 100 as percentile from (select *, row_number() over (order by trade_date) as n from pd) a left join (select *, row_number() over (order by trade_date) as n from pd) b on b.n between a.n - 120 and a.n - 1 group by 1, 2", {"pd": _DAY}),
    "w16_avg_rank_pct": (w16, "select stock_code, trade_date, case when n = 1 then 100 else (r - 1 + (k - 1) / 2) / (n - 1) * 100 end as place from (select *, rank() over (partition by trade_date order by volume_hand) as r, count(*) over (partition by trade_date, volume_hand) as k, count(*) over (partition by trade_date) as n from bars)"),
    "w17_calendar_streak": (w17, (W17 := "select stock_code, trade_date, row_number() over (partition by stock_code, idx - r order by idx) as board_count from (select *, row_number() over (partition by stock_code order by idx) as r from (select distinct e.stock_code, e.trade_date, c.idx from limit_events e join calendar c on c.trade_date = e.trade_date where event_type = 'limit_up'))")),
    "w18_rank_delta": (w18, "select stock_code, round_time, rank, lag(rank) over (partition by stock_code order by round_time) - rank as rank_change from (select *, row_number() over (partition by round_time order by change_pct desc, stock_code) as rank from quotes)"),
    "w19_change_points": (w19, "select round_time, state, p as previous_state from (select *, lag(state) over (order by round_time) as p, row_number() over (order by round_time) as n from (select round_time, case when 100 * count(*) filter (change_pct > 0) / count(*) >= 65 then 'broad' when 100 * count(*) filter (change_pct > 0) / count(*) <= 35 then 'weak' else 'mixed' end as state from quotes group by 1)) where n > 1 and state <> p"),
    "w20_crossed_up": (w20, f"select stock_code, trade_date, ma5, ma10 from (select *, lag(ma5) {_W}) as p5, lag(ma10) {_W}) as p10 from (select *, round({_ma('close_price', 5)}, 6) as ma5, round({_ma('close_price', 10)}, 6) as ma10 from bars)) where p5 <= p10 and ma5 > ma10"),
    "w21_forward_compound": (w21, f"select stock_code, trade_date, round(((1 + lead(change_pct, 1) {_W}) / 100) * (1 + lead(change_pct, 2) {_W}) / 100) * (1 + lead(change_pct, 3) {_W}) / 100) - 1) * 100, 6) as forward_3 from bars"),
    "w22_baseline_ratio": (w22, "select trade_date, round(case when count(amount) over (order by trade_date rows between 5 preceding and 1 preceding) >= 3 then amount / avg(amount) over (order by trade_date rows between 5 preceding and 1 preceding) end, 6) as ratio from pd", {"pd": _DAY}),
    "w23_recent_high_slope": (w23, "select trade_date, coalesce(max(up) over (order by trade_date rows between 5 preceding and 1 preceding), up) as recent_high, up - coalesce(lag(up) over (order by trade_date), up) as slope from pd", {"pd": _DAY}),
}
QUERIES = {name: entry[0] for name, entry in TABLE.items()}
ORACLES = {name: with_frames(entry[1], **(entry[2] if len(entry) > 2 else {})) for name, entry in TABLE.items()}
