"""Registered queries of market insight, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import windows as W
from ..operators import insight as I
from ..sources import domain as D
from . import factor_queries as Q
from .oracle import with_frames


def announcements(spark, d):
    """Documents as announcements: each of a stock, published on an open day."""
    days = D.calendar(spark, d).select("idx", F.col("trade_date").alias("published"))
    docs = D.table(spark, d, "documents").select("doc_id", F.lpad((F.col("doc_id") % 100 + 1).cast("string"), 6, "0").alias("stock_code"), (F.col("doc_id") * 7 % 500 + 1).alias("idx"), F.substring("text", 1, 40).alias("title"))
    return docs.join(F.broadcast(days), "idx").drop("idx")


def breadth(spark, d):
    return I.breadth(D.bars(spark, d), D.stocks(spark, d))


def boards(spark, d):
    return W.calendar_streak(Q.ups(spark, d), D.calendar(spark, d))


def premium(spark, d):
    return I.limit_up_premium(D.bars(spark, d), D.limit_events(spark, d), D.calendar(spark, d))


def metrics(spark, d):
    return I.market_metrics(D.bars(spark, d), D.stocks(spark, d), D.flow(spark, d), Q.f01(spark, d), D.basic(spark, d), D.calendar(spark, d))


def highs(spark, d):
    return I.new_high_low(D.bars(spark, d), D.stocks(spark, d), D.calendar(spark, d))


def concepts(spark, d):
    return I.concept_metrics(D.bars(spark, d), D.members(spark, d), D.limit_events(spark, d), D.flow(spark, d))


def heat(spark, d):
    return I.concept_heat(concepts(spark, d))


def index(spark, d):
    return I.index_metrics(Q.index_bars(spark, d))


def sentiment(spark, d):
    top = boards(spark, d).groupBy("trade_date").agg(F.max("board_count").alias("highest_board"))
    n = I.eligible(D.stocks(spark, d)).agg(F.count("*").alias("active"))
    b = breadth(spark, d).crossJoin(F.broadcast(n))  # one row
    return I.sentiment(b, I.limit_counts(D.limit_events(spark, d)), premium(spark, d), top, F.col("active"))


def raw(spark, d):
    return I.emotion_raw(metrics(spark, d), D.limit_events(spark, d), D.bars(spark, d), boards(spark, d), heat(spark, d), premium(spark, d), index(spark, d), highs(spark, d), D.calendar(spark, d))


def percentiles(spark, d):
    return I.emotion_percentiles(raw(spark, d))


def scores(spark, d):
    return I.emotion_scores(percentiles(spark, d))


def stages(spark, d):
    r = D.once(raw(spark, d))  # a row a day
    return I.emotion_stages(I.emotion_scores(I.emotion_percentiles(r)), r)


def validation(spark, d):
    r = D.once(raw(spark, d))  # a row a day
    return I.forward_validation(I.emotion_scores(I.emotion_percentiles(r)), r)


def calibration(spark, d):
    r = D.once(raw(spark, d))  # a row a day
    return I.calibration_summary(I.emotion_stages(I.emotion_scores(I.emotion_percentiles(r)), r), r)


def leaders(spark, d):
    return I.sector_leaders(D.bars(spark, d), D.members(spark, d), D.limit_events(spark, d), D.flow(spark, d), heat(spark, d))


def evidence(spark, d):
    return I.limit_up_evidence(D.bars(spark, d), D.limit_events(spark, d), boards(spark, d), D.flow(spark, d), D.members(spark, d), heat(spark, d), announcements(spark, d))


def external(spark, d):
    holdings = D.basic(spark, d).filter("day(trade_date) <= 10").select("trade_date", "total_mv")
    return I.asof_sum(D.calendar(spark, d), holdings, "total_mv", "margin")


ELIGIBLE = "select * from stocks where status = 'active' and not is_st and exchange in ('SH', 'SZ', 'SSE', 'SZSE')"
A1 = """select trade_date, count(*) as daily_bar_count, count(*) filter (change_pct > 0) as up_count, count(*) filter (change_pct < 0) as down_count, count(*) filter (change_pct = 0) as flat_count, round(avg(change_pct), 6) as average_change,
  quantile_cont(change_pct, 0.5) as median_change, cast(sum(cast(amount_yuan as decimal(20,2))) as double) as total_amount from bars b where stock_code in (select stock_code from eligible) group by 1"""
A2 = "select trade_date, count(*) filter (event_type = 'limit_up') as limit_up_count, count(*) filter (event_type = 'limit_down') as limit_down_count, count(*) filter (event_type = 'limit_break') as limit_break_count from limit_events group by 1"
UPS = "select distinct stock_code, trade_date from limit_events where event_type = 'limit_up'"
A5 = "select b.trade_date, round(avg(change_pct), 6) as premium, count(change_pct) as stock_count from bars b join calendar c on c.trade_date = b.trade_date join upd e on e.stock_code = b.stock_code and e.trade_date = c.previous_trade_date group by 1"
AGED = "select s.stock_code, min(idx) as first from eligible s join calendar c on c.trade_date >= s.list_date group by 1"
A3 = """select b.trade_date, count(*) as daily_bar_count, count(*) filter (change_pct > 0) as up_count, count(*) filter (change_pct < 0) as down_count, quantile_cont(change_pct, 0.5) as median_change_pct, count(*) filter (change_pct >= 5) as wide_up_count, count(*) filter (change_pct <= -5) as wide_down_count,
  cast(sum(cast(amount_yuan as decimal(20,2))) as double) as total_amount_yuan, cast(sum(cast(main_net_inflow as decimal(20,2))) as double) as main_net_inflow, count(*) filter (close_price >= ma20) as above_ma20_count, count(*) filter (close_price >= ma60) as above_ma60_count, count(ma20) as factor_count,
  cast(sum(cast(volatility_20d as decimal(20,6))) as double) / count(volatility_20d) as volatility_20d, cast(sum(cast(x.amount_ratio as decimal(20,6))) as double) / count(x.amount_ratio) as amount_ratio, cast(sum(cast(turnover_rate as decimal(20,6))) as double) / count(turnover_rate) as turnover_rate
from bars b join aged g on g.stock_code = b.stock_code join calendar k on k.idx = g.first + 5 left join flow f on f.stock_code = b.stock_code and f.trade_date = b.trade_date left join f1 x on x.stock_code = b.stock_code and x.trade_date = b.trade_date left join basic t on t.stock_code = b.stock_code and t.trade_date = b.trade_date
where b.trade_date >= k.trade_date group by 1"""
A4 = """select b.trade_date, count(*) as stock_count, count(*) filter (close_price >= hi) as new_high_20, count(*) filter (close_price <= lo) as new_low_20
from (select *, max(close_price) over (w rows between 19 preceding and current row) as hi, min(close_price) over (w rows between 19 preceding and current row) as lo from bars window w as (partition by stock_code order by trade_date)) b join aged g on g.stock_code = b.stock_code join calendar k on k.idx = g.first + 19 where b.trade_date >= k.trade_date group by 1"""
A6 = """select b.trade_date, sector_code, count(change_pct) as priced, count(*) filter (change_pct > 0) as rising, count(*) filter (change_pct < 0) as falling, count(u.stock_code) as limit_ups, count(main_net_inflow) as flow_count, round(avg(change_pct), 6) as average_change, quantile_cont(change_pct, 0.5) as median_change, cast(sum(cast(main_net_inflow as decimal(20,2))) as double) as net_inflow
from member_bars b left join upd u on u.stock_code = b.stock_code and u.trade_date = b.trade_date left join flow f on f.stock_code = b.stock_code and f.trade_date = b.trade_date group by 1, 2"""
A7 = "select trade_date, round(avg((close_price / pre_close_price - 1) * 100), 6) as index_change, round(avg((high_price - low_price) / close_price * 100), 6) as index_amplitude, count(*) as n from idx group by 1"


def _place(c: str) -> str:
    return f"case when {c} is null then null when count({c}) over (partition by trade_date) = 1 then 100 else (rank() over (partition by trade_date, {c} is null order by {c}) - 1 + (count(*) over (partition by trade_date, {c}) - 1) / 2) / (count({c}) over (partition by trade_date) - 1) * 100 end"


M9 = f"""select trade_date, sector_code, heat, row_number() over (partition by trade_date order by heat desc nulls last, average_change desc nulls last, sector_code) as heat_rank, priced, limit_ups
from (select *, round((coalesce(p1, 0) * 0.35 + coalesce(p2, 0) * 0.25 + coalesce(p3, 0) * 0.25 + coalesce(p4, 0) * 0.15) / (case when p1 is null then 0 else 0.35 end + case when p2 is null then 0 else 0.25 end + case when p3 is null then 0 else 0.25 end + case when p4 is null then 0 else 0.15 end), 4) as heat
from (select *, {_place('average_change')} as p1, rising / priced * 100 as p2, {_place('density')} as p3, {_place('flow')} as p4 from (select *, limit_ups / priced as density, case when flow_count > 0 then net_inflow end as flow from a6 where priced >= 3)))""".replace("0.35", "0.35::double").replace("0.25", "0.25::double").replace("0.15", "0.15::double")
M1 = """select trade_date, case when ready then 'ready' else 'pending' end as status, score, case when score is null then 'pending' when score <= 25 then 'ice_point' when score < 40 then 'retreat' when score < 60 then 'chaos' when score < 75 then 'recovery' when p1 >= 70 and p2 >= 70 and coalesce(highest_board, 0) >= 3 and coalesce(premium, 0) >= 0 then 'main_up' else 'active' end as stage
from (select *, lag(score ignore nulls) over (order by trade_date) as p1, lag(score, 2 ignore nulls) over (order by trade_date) as p2 from (
  select *, case when ready then round((c1 * 0.3 + coalesce(c2, 0) * 0.2 + c3 * 0.2 + coalesce(c4, 0) * 0.1 + coalesce(c5, 0) * 0.12 + coalesce(c6, 0) * 0.08) / (0.3 + case when c2 is null then 0 else 0.2 end + 0.2 + case when c4 is null then 0 else 0.1 end + case when c5 is null then 0 else 0.12 end + case when c6 is null then 0 else 0.08 end), 4) end as score from (
    select a.trade_date, premium, highest_board, a.daily_bar_count / act * 100 >= 95 as ready, up_count / act * 100 as c1, greatest(0, least(100, 50 + 12.5 * median_change)) + case when median_change is null then null else 0 end as c2, greatest(0, least(100, coalesce(limit_up_count, 0) / act * 5000)) as c3,
      coalesce(limit_up_count, 0) / nullif(coalesce(limit_up_count, 0) + coalesce(limit_break_count, 0), 0) * 100 as c4, case when premium is not null then greatest(0, least(100, 50 + 10 * premium)) end as c5, case when r is not null then greatest(0, least(100, (r - 0.6) / 0.8 * 100)) end as c6
    from (select *, (select cast(count(*) as double) from eligible) as act, case when count(total_amount) over (order by trade_date rows between 5 preceding and 1 preceding) >= 3 then total_amount / avg(total_amount) over (order by trade_date rows between 5 preceding and 1 preceding) end as r from a1) a
    left join a2 on a2.trade_date = a.trade_date left join a5 on a5.trade_date = a.trade_date left join (select trade_date, max(board_count) as highest_board from w17 group by 1) w on w.trade_date = a.trade_date)))""".replace("0.3 ", "0.3::double ").replace("(r - 0.6) / 0.8", "(r - 0.6::double) / 0.8::double")
M3 = """select m.trade_date, coalesce("natural", 0) as natural_limit_up_count, coalesce(downs, 0) as qualified_limit_down_count, coalesce(downs, 0) / daily_bar_count * 100 as qualified_limit_down_density, coalesce(breaks, 0) / nullif(coalesce(ups, 0) + coalesce(breaks, 0), 0) * 100 as limit_break_rate, coalesce(kept, 0) / had * 100 as board_promotion_rate,
  cast(coalesce(highest, 0) * 10 + least(coalesce(multi, 0), 10) as double) as board_structure, coalesce(highest, 0) as highest_board_count, up_count / daily_bar_count * 100 as up_ratio_pct, median_change_pct, wide_up_count / nullif(wide_up_count + wide_down_count, 0) * 100 as wide_move_ratio, premium as previous_limit_up_premium,
  h1.limit_ups / h1.priced * 100 as theme_limit_up_density, coalesce(again, 0) / top_before * 100 as theme_persistence, h1.heat as leader_strength, round(r, 4) as amount_vs_5d_average, main_net_inflow as main_net_inflow_strength, above_ma20_count / nullif(factor_count, 0) * 100 as above_ma20_ratio, above_ma60_count / nullif(factor_count, 0) * 100 as above_ma60_ratio,
  new_high_20 / a4.stock_count * 100 - new_low_20 / a4.stock_count * 100 as new_high_low_spread, case when amount_ratio is null then turnover_rate when turnover_rate is null then amount_ratio else (amount_ratio + turnover_rate) / 2 end as turnover_volume_expansion, index_change as core_index_trend, index_amplitude, volatility_20d
from (select *, case when count(total_amount_yuan) over (order by trade_date rows between 5 preceding and 1 preceding) >= 5 then total_amount_yuan / avg(total_amount_yuan) over (order by trade_date rows between 5 preceding and 1 preceding) end as r from a3) m
left join (select e.trade_date, count(*) filter (event_type = 'limit_up') as ups, count(*) filter (event_type = 'limit_up' and not coalesce(abs(limit_price - open_price) < 0.0001 and open_count = 0, false)) as "natural", count(*) filter (event_type = 'limit_down') as downs, count(*) filter (event_type = 'limit_break') as breaks from limit_events e left join bars b on b.stock_code = e.stock_code and b.trade_date = e.trade_date group by 1) l on l.trade_date = m.trade_date
left join (select trade_date, max(board_count) as highest, count(*) filter (board_count >= 2) as multi from w17 group by 1) w on w.trade_date = m.trade_date
left join (select u.trade_date, count(*) as kept from upd u join calendar c on c.trade_date = u.trade_date join upd v on v.stock_code = u.stock_code and v.trade_date = c.previous_trade_date group by 1) k on k.trade_date = m.trade_date
left join (select next_trade_date, count(*) as had from upd join calendar using (trade_date) group by 1) b on b.next_trade_date = m.trade_date
left join (select x.trade_date, count(*) as again from m9 x join calendar c on c.trade_date = x.trade_date join m9 y on y.sector_code = x.sector_code and y.trade_date = c.previous_trade_date and y.heat_rank <= 5 where x.heat_rank <= 5 group by 1) g on g.trade_date = m.trade_date
left join (select next_trade_date, count(*) as top_before from m9 join calendar using (trade_date) where heat_rank <= 5 group by 1) t on t.next_trade_date = m.trade_date
left join (select * from m9 where heat_rank = 1) h1 on h1.trade_date = m.trade_date left join a5 on a5.trade_date = m.trade_date left join a7 on a7.trade_date = m.trade_date left join a4 on a4.trade_date = m.trade_date"""
_NAMES = ["natural_limit_up_count", "qualified_limit_down_count", "qualified_limit_down_density", "limit_break_rate", "board_promotion_rate", "board_structure", "up_ratio_pct", "median_change_pct", "wide_move_ratio", "previous_limit_up_premium", "theme_limit_up_density", "theme_persistence", "leader_strength", "amount_vs_5d_average", "main_net_inflow_strength", "above_ma20_ratio", "above_ma60_ratio", "new_high_low_spread", "turnover_volume_expansion", "core_index_trend", "index_amplitude", "volatility_20d"]
LONG = " union all ".join(f"select trade_date, '{n}' as metric, cast({n} as double) as value from m3" for n in _NAMES)
M4P = f"""select a.trade_date, a.metric, a.value, count(b.value) as sample, case when a.value is null or count(b.value) = 0 then null when a.metric in ({', '.join(f"'{n}'" for n in I.NEGATIVE)}) then 100 - (count(*) filter (b.value < a.value) + 0.5::double * count(*) filter (b.value = a.value)) / count(b.value) * 100 else (count(*) filter (b.value < a.value) + 0.5::double * count(*) filter (b.value = a.value)) / count(b.value) * 100 end as percentile
from (select *, count(value) over (partition by metric order by trade_date rows between unbounded preceding and 1 preceding) as n from long) a left join (select *, row_number() over (partition by metric order by trade_date) as n from long where value is not null) b on b.metric = a.metric and b.n between a.n - 119 and a.n group by 1, 2, 3"""


def _card(card: dict[str, int]) -> str:
    return "case metric " + " ".join(f"when '{k}' then {v}" for k, v in card.items()) + " else 0 end"


M4 = f"""select trade_date, round(sum(s * coalesce(percentile, 0)) / nullif(sum(s), 0), 8) as short_score, round(sum(r * coalesce(percentile, 0)) / nullif(sum(r), 0), 8) as risk_score
from (select *, case when value is not null and sample >= 60 then {_card(I.SHORT_TERM)} else 0 end as s, case when value is not null and sample >= 60 then {_card(I.RISK_ON)} else 0 end as r from m4p) group by 1"""
M5 = """select trade_date, short_score, risk_score, round(slope, 6) as slope, case when short_score <= 28 and risk_score <= 42 and slope <= 0 then 'ice_point' when short_score < 42 and (slope < 0 or qualified_limit_down_count > natural_limit_up_count) then 'retreat' when short_score >= 82 and risk_score >= 65 and natural_limit_up_count > 0 then 'climax' when short_score >= 48 and slope > 0 and risk_score >= 42 then 'recovery' else 'active' end as stage,
  case when limit_break_rate >= 40 and high - short_score >= 12 then 'divergence' when qualified_limit_down_count >= greatest(8, natural_limit_up_count) and short_score < 40 then 'panic_release' when board_promotion_rate >= 35 and highest_board_count >= 3 then 'acceleration' when theme_persistence >= 40 then 'ferment' when short_score < 50 and coalesce(theme_persistence, 0) < 20 then 'rotation' else 'trial' end as auxiliary
from (select *, coalesce(max(short_score) over (order by trade_date rows between 5 preceding and 1 preceding), short_score) as high, short_score - coalesce(lag(short_score) over (order by trade_date), short_score) as slope from (select * from m4 where short_score is not null and risk_score is not null) join m3 using (trade_date))"""
M7 = """select * from (with f as (select trade_date, h as horizon, case h when 1 then b1 else b3 end as breadth, case h when 1 then c1 else c3 end as core from (select trade_date, lead(up_ratio_pct, 1) over w as b1, lead(up_ratio_pct, 3) over w as b3, round((1 + lead(core_index_trend) over w / 100 - 1) * 100, 4) as c1, round(((1 + lead(core_index_trend, 1) over w / 100) * (1 + lead(core_index_trend, 2) over w / 100) * (1 + lead(core_index_trend, 3) over w / 100) - 1) * 100, 4) as c3 from m3 window w as (order by trade_date)), (values (1), (3)) hs(h)),
s as (select * from (select trade_date, 'short' as score, short_score as value from m4 union all select trade_date, 'risk', risk_score from m4) where value is not null),
j as (select * from s join f using (trade_date) where breadth is not null or core is not null),
m as (select score, horizon, bucket, count(*) as sample, round(avg(breadth), 2) as mean_breadth, round(avg(core), 4) as mean_core, count(*) filter (breadth > 50) / nullif(count(breadth), 0) * 100 as breadth_above_50, count(*) filter (core > 0) / nullif(count(core), 0) * 100 as core_positive
  from (select *, unnest([case when value < 40 then 'low' when value < 70 then 'middle' else 'high' end, 'all']) as bucket from j) group by 1, 2, 3),
e as (select score, horizon, round(max(mean_breadth) filter (bucket = 'high') - max(mean_breadth) filter (bucket = 'low'), 2) as breadth_difference, round(max(mean_core) filter (bucket = 'high') - max(mean_core) filter (bucket = 'low'), 4) as core_difference, least(coalesce(max(sample) filter (bucket = 'high'), 0), coalesce(max(sample) filter (bucket = 'low'), 0)) as n from m group by 1, 2),
r as (select score, horizon, o, case when count(*) >= 3 and count(*) * sum(x * x) - sum(x) * sum(x) > 0 and count(*) * sum(y * y) - sum(y) * sum(y) > 0 then round((count(*) * sum(x * y) - sum(x) * sum(y)) / (sqrt(count(*) * sum(x * x) - sum(x) * sum(x)) * sqrt(count(*) * sum(y * y) - sum(y) * sum(y))), 6) end as rho from (
  select score, horizon, o, rank() over (partition by score, horizon, o order by value) + (count(*) over (partition by score, horizon, o, value) - 1) / 2 as x, rank() over (partition by score, horizon, o order by z) + (count(*) over (partition by score, horizon, o, z) - 1) / 2 as y
  from (select score, horizon, value, 'breadth' as o, breadth as z from j union all select score, horizon, value, 'core', core from j) where z is not null) group by 1, 2, 3)
select m.*, breadth_difference, core_difference, case when n is null then null when n < 15 then 'insufficient_samples' when breadth_difference is null and core_difference is null then 'insufficient_outcomes' when coalesce(breadth_difference, 0) >= 0 and coalesce(core_difference, 0) >= 0 then 'positive' when coalesce(breadth_difference, 0) <= 0 and coalesce(core_difference, 0) <= 0 then 'inverse' else 'mixed' end as relationship, rb.rho as rho_breadth, rc.rho as rho_core
from m left join e on e.score = m.score and e.horizon = m.horizon and m.bucket = 'all' left join r rb on rb.score = m.score and rb.horizon = m.horizon and rb.o = 'breadth' and m.bucket = 'all' left join r rc on rc.score = m.score and rc.horizon = m.horizon and rc.o = 'core' and m.bucket = 'all')"""
ANN = "select doc_id, lpad(cast(doc_id % 100 + 1 as varchar), 6, '0') as stock_code, trade_date as published from documents join calendar on idx = doc_id * 7 % 500 + 1"
M11 = """select u.stock_code, u.trade_date, u.open_count, w.board_count, close_price, change_pct, main_net_inflow, concepts, best_rank, coalesce(said, 0) as announcements
from (select distinct stock_code, trade_date, open_count from limit_events where event_type = 'limit_up') u left join w17 w on w.stock_code = u.stock_code and w.trade_date = u.trade_date left join bars b on b.stock_code = u.stock_code and b.trade_date = u.trade_date left join flow f on f.stock_code = u.stock_code and f.trade_date = u.trade_date
left join (select stock_code, trade_date, string_agg(sector_code, ',' order by heat_rank, sector_code) as concepts, min(heat_rank) as best_rank from (select b.stock_code, b.trade_date, b.sector_code, heat_rank, row_number() over (partition by b.stock_code, b.trade_date order by heat_rank, b.sector_code) as n from (select u.stock_code, u.trade_date, sector_code from upd u join members m on m.stock_code = u.stock_code and (start_date is null or start_date <= u.trade_date) and (end_date is null or u.trade_date <= end_date)) b join m9 h on h.trade_date = b.trade_date and h.sector_code = b.sector_code) where n <= 3 group by 1, 2) c on c.stock_code = u.stock_code and c.trade_date = u.trade_date
left join (select u.stock_code, u.trade_date, least(count(*), 3) as said from upd u join ann a on a.stock_code = u.stock_code and a.published between u.trade_date - 3 and u.trade_date group by 1, 2) s on s.stock_code = u.stock_code and s.trade_date = u.trade_date"""
ALL = {"eligible": ELIGIBLE, "upd": UPS, "w17": Q.W17, "f1": Q.F1, "idx": Q.INDEX, "member_bars": Q.ASOF, "a1": A1, "a2": A2, "a5": A5, "aged": AGED, "a3": A3, "a4": A4, "a6": A6, "a7": A7, "m9": M9, "m1": M1, "m3": M3, "long": LONG, "m4p": M4P, "m4": M4, "m5": M5, "ann": ANN, "m11": M11}


def q(body: str) -> str:
    return with_frames(body, **ALL)


TABLE = {
    "a01_breadth": (breadth, A1),
    "a02_limit_counts": (lambda s, d: I.limit_counts(D.limit_events(s, d)), A2),
    "a03_market_metrics": (metrics, A3),
    "a04_new_high_low": (highs, A4),
    "a05_limit_up_premium": (premium, A5),
    "a06_concept_metrics": (concepts, A6),
    "a07_index_metrics": (index, A7),
    "a08_asof_external": (external, "select c.trade_date, max(h.trade_date) as as_of, arg_max(v, h.trade_date) as margin from calendar c left join (select trade_date, cast(sum(cast(total_mv as decimal(20,2))) as double) as v from basic where day(trade_date) <= 10 group by 1) h on h.trade_date <= c.trade_date group by 1"),
    "a21_spearman": (lambda s, d: I.spearman(D.bars(s, d).select("trade_date", "volume_hand", "change_pct"), "volume_hand", "change_pct", ["trade_date"]), """select trade_date, n, case when n >= 3 and vx > 0 and vy > 0 then round(t / (sqrt(vx) * sqrt(vy)), 6) end as rho from (select trade_date, count(*) as n, count(*) * sum(x * y) - sum(x) * sum(y) as t, count(*) * sum(x * x) - sum(x) * sum(x) as vx, count(*) * sum(y * y) - sum(y) * sum(y) as vy from (
select trade_date, cast(rank() over (partition by trade_date order by volume_hand) + (count(*) over (partition by trade_date, volume_hand) - 1) / 2 as double) as x, cast(rank() over (partition by trade_date order by change_pct) + (count(*) over (partition by trade_date, change_pct) - 1) / 2 as double) as y from bars where change_pct is not null) group by 1)"""),
    "m01_sentiment": (sentiment, M1),
    "m03_emotion_raw": (raw, M3),
    "m04_emotion_percentiles": (percentiles, M4P),
    "m04_emotion_scores": (scores, M4),
    "m05_emotion_stages": (stages, M5),
    "m07_forward_validation": (validation, M7),
    "m08_calibration": (calibration, "select * from (select stage, count(*) as days, min(short_score) as low, max(short_score) as high, round(avg(short_score), 6) as mean from m5 group by 1), (select count(*) as ready, min(short_score) as score_min, max(short_score) as score_max, round(avg(short_score), 2) as score_mean, (select count(*) from m3) as processed, 250::bigint as requested, count(*) >= 250 and (select count(*) from m3) >= 250 as baseline_complete from m5)"),
    "m09_concept_heat": (heat, M9),
    "m10_sector_leaders": (leaders, """select trade_date, sector_code, n as place, stock_code, up as limit_up from (select b.trade_date, b.sector_code, b.stock_code, u.stock_code is not null as up, row_number() over (partition by b.trade_date, b.sector_code order by u.stock_code is not null desc, change_pct desc nulls last, main_net_inflow desc nulls last, b.stock_code) as n
from member_bars b join m9 h on h.trade_date = b.trade_date and h.sector_code = b.sector_code and heat_rank <= 24 left join upd u on u.stock_code = b.stock_code and u.trade_date = b.trade_date left join flow f on f.stock_code = b.stock_code and f.trade_date = b.trade_date) where n <= 3"""),
    "m11_limit_up_evidence": (evidence, M11),
    "m12_daily_review": (lambda s, d: I.daily_review(sentiment(s, d), heat(s, d), evidence(s, d)), "select trade_date, coalesce(c, 0) as concepts, coalesce(l, 0) as limit_ups, status = 'ready' and c is not null and l is not null as ready, concat_ws(',', case when status <> 'ready' then 'sentiment_pending' end, case when c is null then 'heat_missing' end, case when l is null then 'evidence_missing' end) as reasons from m1 left join (select trade_date, count(*) as c from m9 where heat is not null group by 1) h using (trade_date) left join (select trade_date, count(*) as l from m11 group by 1) e using (trade_date)"),
    "m13_limit_ladder": (lambda s, d: I.limit_ladder(D.limit_events(s, d), boards(s, d)), """select trade_date, board_count, count(*) as stocks, count(*) > 20 as truncated, string_agg(stock_code, ',' order by n) filter (n <= 20) as codes, round(any_value(limit_up_count / (limit_up_count + limit_break_count) * 100), 6) as seal_rate
from (select e.trade_date, board_count, e.stock_code, row_number() over (partition by e.trade_date, board_count order by first_time nulls last, e.stock_code) as n from limit_events e join w17 w on w.stock_code = e.stock_code and w.trade_date = e.trade_date where event_type = 'limit_up') join a2 using (trade_date) group by 1, 2"""),
    "j09_kth_open_after": (lambda s, d: I.kth_open_after(D.stocks(s, d), D.calendar(s, d), 19), "select stock_code, k.trade_date as kth_date from (select s.stock_code, min(idx) as first from stocks s join calendar c on c.trade_date >= s.list_date group by 1) join calendar k on k.idx = first + 19"),
    "j07_prev_day_join": (lambda s, d: I.prev_day_join(D.bars(s, d), Q.ups(s, d), D.calendar(s, d)).select("stock_code", "trade_date", "previous_trade_date", "change_pct"), "select b.stock_code, b.trade_date, c.previous_trade_date, change_pct from bars b join calendar c on c.trade_date = b.trade_date join upd e on e.stock_code = b.stock_code and e.trade_date = c.previous_trade_date"),
    "j06_membership_asof": (lambda s, d: I.membership_asof(D.bars(s, d), D.members(s, d)).select("stock_code", "trade_date", "sector_code"), "select stock_code, trade_date, sector_code from member_bars"),
}
QUERIES = {name: entry[0] for name, entry in TABLE.items()}
ORACLES = {name: q(entry[1]) for name, entry in TABLE.items()}
