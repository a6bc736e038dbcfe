"""Registered queries of strategy research, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import factors as X
from ..operators import strategy as S
from ..sources import domain as D
from . import factor_queries as Q
from . import insight_queries as N
from .oracle import with_frames


def best_rank(spark, d):
    return X.membership_asof(Q.ups(spark, d), D.members(spark, d)).join(N.heat(spark, d).filter("heat_rank is not null"), ["trade_date", "sector_code"]).groupBy("stock_code", "trade_date").agg(F.min("heat_rank").alias("best_rank"))


def frame(spark, d, themes=False):
    rank = best_rank(spark, d) if themes else Q.ups(spark, d).select("stock_code", "trade_date", F.lit(None).cast("long").alias("best_rank"))
    return S.evaluation_frame(D.bars(spark, d), Q.f01(spark, d), D.basic(spark, d), D.flow(spark, d), D.limit_events(spark, d), N.boards(spark, d), rank)


def gated(spark, d):
    return S.universe_gate(frame(spark, d), D.stocks(spark, d), 60, 20000.0).filter("reason is null")


def screened(spark, d):
    """The rows that three rules of bars and factors match; these need no other side."""
    return S.screen_all(S.evaluation_frame(D.bars(spark, d), Q.f01(spark, d)), ("trend_breakout", "ma_golden_cross", "volume_price_surge"))


def outcomes(spark, d):
    return S.signal_outcomes(Q.w20(spark, d).select("stock_code", "trade_date"), D.bars(spark, d), D.calendar(spark, d))


def trades_with_facts(spark, d):
    return outcomes(spark, d).join(Q.f01(spark, d).select("stock_code", "trade_date", "volume_ratio", "close_position"), ["stock_code", "trade_date"])


BASE, STRICTER, FACTS = {"volume_ratio_min": 0.5, "close_position_min": 0.3}, {"volume_ratio_min": [1.0, 1.5], "close_position_min": [0.5, 0.7]}, {"volume_ratio_min": "volume_ratio", "close_position_min": "close_position"}


def grid(spark, d):
    return S.grid(spark, BASE, STRICTER)


def evaluated(spark, d):
    t = trades_with_facts(spark, d)
    return S.evaluate_grid(t, grid(spark, d), FACTS, S.train_end_date(t))


STATUSES = ("closed", "pending_confirmation", "watching", "rejected", "entered")


def reconciled(spark, d):
    old = screened(spark, d).filter("day(trade_date) % 2 = 0 or rule = 'trend_breakout'").withColumn("status", F.element_at(F.array(*map(F.lit, STATUSES)), F.dayofmonth("trade_date") % 5 + 1))
    new = screened(spark, d).filter("score >= 80")
    return S.reconcile_candidates(old, new, ["rule", "trade_date", "stock_code"])


def trades(spark, d):
    o = D.table(spark, d, "orders")
    return o.select(F.concat(F.lit("s"), F.col("o_custkey") % 5).alias("rule"), F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "pending").otherwise("closed").alias("status"), F.col("o_orderdate").cast("date").alias("trade_date"), F.col("o_totalprice").alias("value"))


def pnl(spark, d):
    legs = D.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("trade_id"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), (F.col("l_quantity") * 100).cast("long").alias("quantity"))
    t = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("trade_id"), (F.col("o_totalprice") / 1000).alias("entry_price"))
    return S.realized_pnl(legs, t)


RANK = "select b.stock_code, b.trade_date, min(heat_rank) as best_rank from (select u.stock_code, u.trade_date, sector_code from upd u join members m on m.stock_code = u.stock_code and (start_date is null or start_date <= u.trade_date) and (end_date is null or u.trade_date <= end_date)) b join m9 h on h.trade_date = b.trade_date and h.sector_code = b.sector_code group by 1, 2"


def _frame(rank: str) -> str:
    return f"""select b.*, f.ma5, f.ma10, f.ma20, f.ma60, f.volume_ratio, f.amount_ratio, f.volatility_20d, f.close_position, f.history_days, prev_ma5, prev_ma10, turnover_rate, main_net_inflow, main_net_inflow / amount_yuan * 100 as main_net_ratio, is_limit_up, is_break, open_count, board_count, {'best_rank' if rank else 'cast(null as bigint) as best_rank'}
from (select *, max(high_price) over (w rows between 20 preceding and 1 preceding) as prior_high, min(low_price) over (w rows between 20 preceding and 1 preceding) as prior_low from bars window w as (partition by stock_code order by trade_date)) b
left join (select *, lag(ma5) over w as prev_ma5, lag(ma10) over w as prev_ma10 from f1 window w as (partition by stock_code order by trade_date)) f on f.stock_code = b.stock_code and f.trade_date = b.trade_date left join basic t on t.stock_code = b.stock_code and t.trade_date = b.trade_date left join flow x on x.stock_code = b.stock_code and x.trade_date = b.trade_date
left join (select stock_code, trade_date, bool_or(event_type = 'limit_up') as is_limit_up, bool_or(event_type = 'limit_break') as is_break, max(open_count) filter (event_type = 'limit_up') as open_count from limit_events group by 1, 2) e on e.stock_code = b.stock_code and e.trade_date = b.trade_date left join w17 w on w.stock_code = b.stock_code and w.trade_date = b.trade_date{' left join ' + rank + ' r on r.stock_code = b.stock_code and r.trade_date = b.trade_date' if rank else ''}"""


SCREENS = {
    "trend_breakout": ("close_price >= prior_high and change_pct >= 2 and change_pct < 9.5 and amount_ratio >= 1.5 and close_position >= 0.65", "45 + least((close_price / prior_high - 1) * 1000, 20) + least(amount_ratio * 12, 20) + close_position * 18"),
    "bullish_alignment": ("close_price > ma5 and ma5 > ma10 and ma10 > ma20 and ma20 > ma60 and change_pct >= 1 and volume_ratio >= 1.2", "40 + (close_price / ma60 - 1) * 100 * 2 + least(volume_ratio * 12, 20) + least(change_pct * 3, 20)"),
    "ma_golden_cross": ("prev_ma5 <= prev_ma10 and ma5 > ma10 and change_pct > 0 and volume_ratio >= 1.2", "55 + least((ma5 / ma10 - 1) * 100 * 10, 20) + least(volume_ratio * 10, 15) + least(change_pct * 2, 10)"),
    "volume_price_surge": ("change_pct >= 3 and change_pct < 9.5 and volume_ratio >= 1.8 and amount_ratio >= 1.5 and close_position >= 0.7", "35 + change_pct * 4 + least(volume_ratio * 12, 25) + least(amount_ratio * 8, 15) + close_position * 15"),
    "high_turnover_surge": ("change_pct >= 3 and change_pct < 9.5 and turnover_rate >= 8 and main_net_inflow > 0 and main_net_ratio > 0 and close_position >= 0.65", "30 + change_pct * 3 + least(turnover_rate * 2.5, 25) + least(main_net_ratio * 3, 20) + close_position * 15"),
    "low_volatility_leader": ("close_price > ma20 and volatility_20d <= 2.5 and change_pct >= 2 and volume_ratio >= 1.3 and close_position >= 0.65", "45 + (close_price / ma20 - 1) * 100 * 4 + greatest(0, 20 - volatility_20d * 6) + least(volume_ratio * 8, 15) + least(change_pct * 2, 12)"),
    "pullback_ma20_bounce": ("low_price <= ma20 * 1.01::double and close_price >= ma20 and close_price > open_price and ma5 >= ma10 and ma10 >= ma20 and volume_ratio >= 1 and close_position >= 0.6", "45 + 10 + 15 + least(volume_ratio * 8, 15) + close_position * 15"),
    "n_day_low_reversal": ("low_price <= prior_low * 1.02::double and close_price > open_price and change_pct >= 2 and close_position >= 0.7 and volume_ratio >= 1.2", "40 + 15 + least(change_pct * 4, 25) + least(volume_ratio * 10, 15) + close_position * 12"),
    "theme_first_board_relay": ("is_limit_up and (open_count is null or open_count > 0) and board_count = 1 and best_rank <= 20", "cast(55 + 20 + greatest(0, 20 - best_rank) + 5 as double)"),
    "consecutive_limit_up_relay": ("is_limit_up and (open_count is null or open_count > 0) and board_count between 2 and 4 and best_rank <= 10", "cast(50 + board_count * 8 + greatest(0, 18 - best_rank) + 12 as double)"),
    "broken_board_recovery": ("is_break and change_pct >= 3 and close_position >= 0.72 and volume_ratio >= 1.5", "35 + 25 + least(change_pct * 3, 20) + least(volume_ratio * 8, 12) + close_position * 12"),
}


def _screen(name: str, source: str = "ev") -> str:
    where, score = SCREENS[name]
    return f"select stock_code, trade_date, '{name}' as rule, round(least({score}, 100), 4) as score from {source} where {where}"


SCREENED = " union all ".join(_screen(n) for n in ("trend_breakout", "ma_golden_cross", "volume_price_surge"))
OUT = """select stock_code, trade_date, why as exit_reason, cast(day + 1 as bigint) as holding_days, (o.open_price * (1 - 0.001::double) / (entry_open * (1 + 0.001::double)) - 1) * 100 as gross_return, (o.open_price * (1 - 0.001::double) / (entry_open * (1 + 0.001::double)) - 1) * 100 - 2 * 0.001::double * 100 as net_return
from (select * from (select *, row_number() over (partition by stock_code, "at" order by day) as n from (
  select *, case when r <= -4 then 'stop_loss' when r >= 8 then 'take_profit' when (peak / (entry_open * (1 + 0.001::double)) - 1) * 100 >= 6 and (peak - close) / peak * 100 >= 3 then 'trailing_stop' when day = 3 then 'time_exit' end as why from (
    select s.stock_code, s.trade_date, s."at", e.open_price as entry_open, p.idx - s."at" as day, p.close_price as close, (p.close_price / (e.open_price * (1 + 0.001::double)) - 1) * 100 as r, max(p.close_price) over (partition by s.stock_code, s."at" order by p.idx) as peak
    from sig s join nb e on e.stock_code = s.stock_code and e.idx = s."at" + 1 and e.open_price > 0 join nb p on p.stock_code = s.stock_code and p.idx between s."at" + 1 and s."at" + 3)) where why is not null) where n = 1) x
join (select stock_code as sc, idx, open_price from nb where open_price > 0) o on o.sc = x.stock_code and o.idx = x."at" + x.day + 1"""
_X = "cast(sum(cast({} as decimal(24,8))) as double)"


def _summary(source: str, by: str) -> str:
    gain, loss = _X.format("case when net_return > 0 then net_return else 0 end"), _X.format("case when net_return < 0 then -net_return else 0 end")
    return f"""select *, round(greatest(0, (wins / trades + 3.8416 / (2 * trades) - 1.96 * sqrt((wins / trades * (1 - wins / trades) + 3.8416 / (4 * trades)) / trades)) / (1 + 3.8416 / trades)), 6) as wilson
from (select {by}, count(*) as trades, count(distinct trade_date) as days, count(*) filter (net_return > 0) as wins, count(*) filter (net_return > 0) / count(*) * 100 as win_rate, {_X.format('net_return')} / count(*) as mean_return, quantile_cont(net_return, 0.5) as median_return, {gain} / nullif({loss}, 0) as profit_factor, max(net_return) as best, min(net_return) as worst from {source} group by {by})"""


TRIALS = sorted(((v != 0.5) + (p != 0.3), p, v) for v in (0.5, 1.0, 1.5) for p in (0.3, 0.5, 0.7))
GRID = "select * from (values " + ", ".join(f"({i}::bigint, {c}::bigint, {p}::double, {v}::double)" for i, (c, p, v) in enumerate(TRIALS)) + ") t(trial, changes, close_position_min, volume_ratio_min)"
END = "select count(*) as days, case when count(*) >= 110 then list_sort(list(trade_date))[cast(floor(count(*) * 0.7) as integer)] end as train_end from (select distinct trade_date from tf)"
EVAL = _summary("(select *, case when trade_date <= train_end then 'train' else 'test' end as split from tf join grid on volume_ratio >= volume_ratio_min and close_position >= close_position_min cross join fin)", "trial, changes, split")
_SIDES = ", ".join(f"any_value({c}) filter (split = '{s}') as {s}_{c}" for s in ("train", "test") for c in ("trades", "days", "win_rate", "mean_return", "median_return", "wilson"))
RANKED = f"""select *, row_number() over (order by verdict = 'eligible' desc, coalesce(test_wilson, 0) desc, coalesce(nullif(test_mean_return, 0), -999) desc, coalesce(nullif(test_median_return, 0), -999) desc, coalesce(test_trades, 0) desc, trial) as place
from (select *, case when coalesce(train_trades, 0) < 300 or coalesce(test_trades, 0) < 120 or coalesce(train_days, 0) < 80 or coalesce(test_days, 0) < 30 then 'data_insufficient' when train_win_rate < 48 or test_win_rate < 50 or train_mean_return <= 0 or test_mean_return <= 0 or drift > 8 then 'rejected' else 'eligible' end as verdict
from (select *, round(abs(coalesce(train_win_rate, 0) - coalesce(test_win_rate, 0)), 4) as drift from (select trial, changes, {_SIDES} from results group by 1, 2)))"""
ALL = N.ALL | {
    "ev": _frame(""), "rk": RANK, "evt": _frame("rk"), "screened": SCREENED, "sig": 'select stock_code, trade_date, idx as "at" from crossed join calendar using (trade_date)', "crossed": Q.TABLE["w20_crossed_up"][1], "nb": "select stock_code, idx, open_price, close_price from bars join calendar using (trade_date)",
    "outcomes": OUT, "tf": "select o.*, volume_ratio, close_position from outcomes o join f1 f on f.stock_code = o.stock_code and f.trade_date = o.trade_date", "grid": GRID, "fin": END, "results": EVAL,
}


def q(body: str) -> str:
    return with_frames(body, **ALL)


def _spark_screen(name: str):
    themes = name in ("theme_first_board_relay", "consecutive_limit_up_relay")
    return lambda s, d: S.screen(frame(s, d, themes), name)


SUMMARY_BY = lambda s, d: S.trade_summary(outcomes(s, d), ["exit_reason"])
OLD = f"select *, ({list(STATUSES)})[day(trade_date) % 5 + 1] as status from screened where day(trade_date) % 2 = 0 or rule = 'trend_breakout'"
TRADES = "select 's' || (o_custkey % 5) as rule, case o_orderstatus when 'O' then 'open' when 'P' then 'pending' else 'closed' end as status, cast(o_orderdate as date) as trade_date, o_totalprice as value from orders"
TABLE = {
    "r01_universe_gate": (lambda s, d: S.universe_gate(frame(s, d), D.stocks(s, d), 60, 40000.0).groupBy("reason").agg(F.count("*").alias("n")), "select case when exchange not in ('SH', 'SZ') then 'unsupported_exchange' when is_st then 'st_excluded' when status <> 'active' then 'inactive_stock' when history_days < 60 then 'listing_history_insufficient' when amount_yuan < 40000 then 'liquidity_insufficient' end as reason, count(*) as n from ev join stocks s on s.stock_code = ev.stock_code group by 1"),
    "r02_market_gate": (lambda s, d: S.market_gate(screened(s, d), N.stages(s, d)).select("stock_code", "trade_date", "rule", "gate"), "select stock_code, trade_date, rule, case when stage is null then null when stage in ('ice_point', 'retreat') then 'market_stage_blocked:' || stage when risk_score < 40 then 'market_risk_on_below_threshold' end as gate from screened left join m5 using (trade_date)"),
    **{f"r{i:02d}_{name}": (_spark_screen(name), _screen(name, "evt" if "relay" in name else "ev")) for i, name in enumerate(SCREENS, 3)},
    "r14_evaluation_frame": (lambda s, d: frame(s, d).select("stock_code", "trade_date", "prior_high", "prior_low", "prev_ma5", "prev_ma10", "main_net_ratio", "is_limit_up", "board_count"), "select stock_code, trade_date, prior_high, prior_low, prev_ma5, prev_ma10, main_net_ratio, is_limit_up, board_count from ev"),
    "r16_candidates": (lambda s, d: S.candidates(screened(s, d), 2), "select * from (select *, row_number() over (partition by rule, trade_date order by score desc, stock_code) as place from screened) where place <= 2"),
    "r17_reconcile": (reconciled, f"select rule, trade_date, stock_code, case when status is null then 'pending_confirmation' when status not in ('pending_confirmation', 'watching') or n then status else 'cancelled' end as status, case when status is null then 'created' when status not in ('pending_confirmation', 'watching') then 'kept' when n then 'refreshed' else 'cancelled' end as action from (select rule, trade_date, stock_code, status from ({OLD})) o full join (select rule, trade_date, stock_code, true as n from screened where score >= 80) x using (rule, trade_date, stock_code)"),
    "r18_signal_outcomes": (outcomes, "select * from outcomes"),
    "r19_qualify": (lambda s, d: S.qualify(SUMMARY_BY(s, d)), f"select *, days >= 120 and trades >= 300 and win_rate >= 50 and mean_return > 0 as qualified from ({_summary('outcomes', 'exit_reason')})"),
    "r20_train_end": (lambda s, d: S.train_end_date(trades_with_facts(s, d)), END),
    "r21_grid": (lambda s, d: S.grid_reach(trades_with_facts(s, d), grid(s, d), FACTS), "select g.*, coalesce(n, 0) as trades, coalesce(k, 0) as days from grid g left join (select trial, count(*) as n, count(distinct trade_date) as k from tf join grid on volume_ratio >= volume_ratio_min and close_position >= close_position_min group by 1) t on t.trial = g.trial"),
    "r22_evaluate_grid": (evaluated, EVAL),
    "r23_rank_trials": (lambda s, d: S.rank_trials(evaluated(s, d)), RANKED),
    "r24_cap_guard": (lambda s, d: S.cap_guard(screened(s, d), 5), "select rule, max(n) as peak, max(n) >= 5 as hit_cap from (select rule, trade_date, count(*) as n from screened group by 1, 2) group by 1"),
    "a14_strategy_summary": (lambda s, d: S.strategy_summary(trades(s, d)), f"select rule, count(*) filter (status = 'open') as open, count(*) filter (status = 'pending') as pending, count(*) filter (status = 'closed') as closed, max(trade_date) as latest, round(avg(value) filter (status = 'closed'), 4) as mean_closed from ({TRADES}) group by 1"),
    "a15_peak_per_day": (lambda s, d: S.peak_per_day(screened(s, d)), "select rule, max(n) as peak from (select rule, trade_date, count(*) as n from screened group by 1, 2) group by 1"),
    "a16_series": (lambda s, d: S.series(D.bars(s, d), "stock_code", ["close_price", "volume_hand"]).select("stock_code", F.size("trade_date").cast("long").alias("n"), F.element_at("close_price", -1).alias("last_close"), F.element_at("volume_hand", 1).alias("first_volume")), "select stock_code, count(*) as n, last(close_price order by trade_date) as last_close, first(volume_hand order by trade_date) as first_volume from bars group by 1"),
    "a17_trade_summary": (SUMMARY_BY, _summary("outcomes", "exit_reason")),
    "a19_realized_pnl": (pnl, "select trade_id, sell_amount, (entry_price * quantity + sell_amount) * 0.001::double as fees, sell_amount - entry_price * quantity - (entry_price * quantity + sell_amount) * 0.001::double as pnl, (sell_amount - entry_price * quantity - (entry_price * quantity + sell_amount) * 0.001::double) / nullif(entry_price * quantity, 0) * 100 as pnl_pct, sell_amount / quantity as exit_price from (select o_orderkey as trade_id, o_totalprice / 1000 as entry_price from orders) join (select l_orderkey as trade_id, cast(sum(cast(l_extendedprice / l_quantity * cast(l_quantity * 100 as bigint) as decimal(28,6))) as double) as sell_amount, cast(sum(cast(l_quantity * 100 as bigint)) as bigint) as quantity from lineitem group by 1) using (trade_id)"),
}
QUERIES = {name: entry[0] for name, entry in TABLE.items()}
ORACLES = {name: q(entry[1]) for name, entry in TABLE.items()}
