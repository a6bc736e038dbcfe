"""Registered queries of realtime operators on static rounds, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.merge import latest_per_key
from ..operators.relational import latest_state
from ..sources import domain as D
from ..streaming import realtime as X
from . import factor_queries as Q
from .oracle import with_frames


def active(spark, d):
    return D.quotes(spark, d).select("stock_code").distinct()


def groups(spark, d):
    return D.quotes(spark, d).select("stock_code").distinct().withColumn("sector_code", F.concat(F.lit("G"), F.col("stock_code").cast("int") % 7))


def latest_factors(spark, d):
    return latest_per_key(Q.f01(spark, d), ["stock_code"], [F.desc("trade_date")])


def pools(spark, d):
    stocks = D.quotes(spark, d).select("stock_code").distinct()
    return stocks.withColumn("pool", F.explode(F.array(F.lit("all"), F.when(F.col("stock_code").cast("int") % 3 == 0, "watch").otherwise("core"))))


def entry_candidates(spark, d):
    n = F.col("stock_code").cast("int") % 3
    return active(spark, d).withColumn("entry_mode", F.when(n == 0, "auction").when(n == 1, "open").otherwise("intraday"))


def sector_strength(spark, d):
    return X.strength(D.quotes(spark, d), groups(spark, d), "sector_code")


def points(spark, d):
    return X.points(X.accepted(D.quotes(spark, d), active(spark, d), LEAST))


def ranked(spark, d):
    return X.ranked(sector_strength(spark, d), points(spark, d), "sector_code").drop("point", "trade_date")


def change_events(spark, d):
    ranks = X.ranked(sector_strength(spark, d), points(spark, d), "sector_code")
    return X.change_events(ranks, X.timeline(D.quotes(spark, d), active(spark, d), LEAST), "sector_code", 2)


def overview(spark, d):
    df = X.market_overview(D.quotes(spark, d), active(spark, d), 3)
    return df.withColumns({c: F.array_join(c, ",") for c in X.RANKINGS})


def targets(spark, d):
    """Pools of stocks by their codes, and each stock's last quote."""
    n = F.col("stock_code").cast("int")
    pools = active(spark, d).select("stock_code", F.explode(F.array(
        F.struct(F.concat(F.lit("p"), n % 5).alias("pool"), (n % 9 * 100).alias("priority"), F.when(n % 3 == 0, "hot").when(n % 3 == 1, "warm").otherwise("off").alias("lane")),
        F.struct(F.lit("q").alias("pool"), F.lit(500).alias("priority"), F.when(n % 7 == 0, "hot").otherwise("off").alias("lane")),
    )).alias("_")).select("stock_code", "_.*").filter("pool <> 'p4'")
    last = latest_per_key(D.quotes(spark, d), ["stock_code"], [F.desc("quote_time")])
    return X.merge_targets(pools, last, 12, 15, active(spark, d))


def held(spark, d):
    """Quotes as paths of trades: each stock is bought at its first quote; a round is polled when it ends."""
    day, w = F.to_date("round_time"), Window.partitionBy("stock_code")
    times = [(F.col("round_time") + F.expr("interval 1 hour")).alias("poll_time"), "quote_time", F.col("round_time").alias("depth_time")]
    bid = F.when(F.col("volume_share") % 3 != 0, F.col("last_price") * 0.999)
    return D.quotes(spark, d).select(F.col("stock_code").cast("long").alias("trade_id"), *times, "last_price", bid.alias("bid"), F.first("last_price").over(w.orderBy("round_time")).alias("entry_price"), (F.col("stock_code").cast("int") % 4 * 100 + 100).alias("quantity"), F.datediff(day, F.min(day).over(w)).alias("holding_days"))


def depth(spark, d):
    side = lambda sign: F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.struct(i.alias("level"), (F.col("last_price") * (1 + sign * i * 0.001)).alias("price"), (F.col("volume_share") * i).alias("volume")))
    return D.quotes(spark, d).select("stock_code", F.col("round_time").alias("depth_time"), side(-1).alias("bids"), F.filter(side(1), lambda x: x["level"] <= F.hour("round_time") % 5 + 1).alias("asks"))


GROUPS = "select distinct stock_code, 'G' || (cast(stock_code as integer) % 7) as sector_code from quotes"
STRENGTH = """select round_time, sector_code, members, quotes, quotes / members * 100 as coverage, case when quotes / members * 100 >= 95 then 'high' when quotes / members * 100 >= 80 then 'medium' else 'low' end as confidence, round(m, 6) as mean_change, median_change, up, down, flat, limit_ups, limit_downs,
  round(least(100, greatest(0, least(35, greatest(0, (m + 3) / 6 * 35)) + up / quotes * 30 + least(25, limit_ups / members * 250) - least(10, limit_downs / members * 100) + least(10, greatest(0, log10(greatest(1, amount)) - 6)))), 4) as heat, leader, laggard
from (select round_time, q.sector_code, count(*) as quotes, cast(sum(cast(change_pct as decimal(20,8))) as double) / count(*) as m, count(*) filter (change_pct > 0) as up, count(*) filter (change_pct < 0) as down, count(*) filter (change_pct = 0) as flat, round(quantile_cont(change_pct, 0.5), 4) as median_change, count(*) filter (abs(limit_up - last_price) <= greatest(0.001, abs(limit_up) * 0.0002::double)) as limit_ups, count(*) filter (abs(limit_down - last_price) <= greatest(0.001, abs(limit_down) * 0.0002::double)) as limit_downs, cast(sum(cast(amount_yuan as decimal(20,4))) as double) as amount,
  first(stock_code order by change_pct desc, stock_code desc) as leader, first(stock_code order by change_pct, stock_code) as laggard from (select * from quotes join grp using (stock_code)) q group by 1, 2) join (select sector_code, count(*) as members from grp group by 1) using (sector_code)"""
LEAST = 0.12  # of stocks, that a round of the tables' events has quotes of
POINTS = f"select round_time, cast(round_time as date) as trade_date, row_number() over (partition by cast(round_time as date) order by round_time) as point from (select round_time from quotes group by 1 having count(distinct stock_code) >= ceil((select count(distinct stock_code) from quotes) * {LEAST}))"
_BEFORE = "case when lag(point) over w = point - 1 then lag({}) over w end"
RANKED = f"""select *, previous_rank - rank as rank_change from (select *, {_BEFORE.format('rank')} as previous_rank, {_BEFORE.format('leader')} as previous_leader
  from (select *, row_number() over (partition by round_time order by heat desc, coverage desc, sector_code) as rank from strength join points using (round_time)) window w as (partition by trade_date, sector_code order by round_time))"""
_STATE = "case when round(up / greatest(quoted, 1) * 100, 2) >= 65 then 'broadly_up' when round(down / greatest(quoted, 1) * 100, 2) >= 65 then 'broadly_down' else 'mixed' end as state"
BOARD = f"""select *, up / greatest(quoted, 1) * 100 as up_share, down / greatest(quoted, 1) * 100 as down_share, flat / greatest(quoted, 1) * 100 as flat_share, {_STATE} from (select round_time, count(*) as quotes, count(change_pct) as quoted, count(*) filter (change_pct > 0) as up, count(*) filter (change_pct < 0) as down, count(*) filter (change_pct = 0) as flat,
  count(*) filter (change_pct >= 5) as up_5, count(*) filter (change_pct >= 3 and change_pct < 5) as up_3, count(*) filter (change_pct > 0 and change_pct < 3) as up_0_to_3, count(*) filter (change_pct < 0 and change_pct > -3) as down_0_to_3, count(*) filter (change_pct <= -3 and change_pct > -5) as down_3, count(*) filter (change_pct <= -5) as down_5,
  round(cast(sum(cast(change_pct as decimal(20,8))) as double) / count(change_pct), 4) as mean_change, quantile_cont(change_pct, 0.5) as median_change, cast(sum(cast(amount_yuan as decimal(20,4))) as double) as amount from quotes q group by 1)"""
LINE = "select trade_date, point, b.round_time, quotes, up, down, flat, mean_change, median_change, amount, state from board b join points p on p.round_time = b.round_time"
_TOP = "select round_time, string_agg(stock_code, ',' order by {0}, stock_code) as {1} from (select *, row_number() over (partition by round_time order by {0}, stock_code) as n from quotes) where n <= 3 group by 1"
OVERVIEW = f"""select b.*, (select count(distinct stock_code) from quotes) as expected, quotes / greatest((select count(distinct stock_code) from quotes), 1) * 100 as coverage, limit_ups, limit_downs, top_gainers, top_losers, top_amount, top_volume from board b
  join (select round_time, count(*) filter (abs(limit_up - last_price) <= greatest(0.001, limit_up * 0.0002::double)) as limit_ups, count(*) filter (abs(limit_down - last_price) <= greatest(0.001, limit_down * 0.0002::double)) as limit_downs from quotes group by 1) l on l.round_time = b.round_time
  join ({_TOP.format('change_pct desc', 'top_gainers')}) g on g.round_time = b.round_time join ({_TOP.format('change_pct', 'top_losers')}) o on o.round_time = b.round_time join ({_TOP.format('amount_yuan desc', 'top_amount')}) a on a.round_time = b.round_time join ({_TOP.format('volume_share desc', 'top_volume')}) v on v.round_time = b.round_time"""
EVENTS = """select round_time, strftime(round_time, '%Y%m%d%H%M%S') || ':' || row_number() over (partition by round_time order by a, b) as event_id, kind, sector_code, rank, previous_rank, value from (
  select round_time, 'market_breadth_changed' as kind, null as sector_code, null as rank, null as previous_rank, state as value, 0 as a, 0 as b from (select *, lag(state) over (partition by trade_date order by round_time) as p from line) where point > 1 and p <> state
  union all select round_time, case when rank_change > 0 then 'rank_up' else 'rank_down' end, sector_code, rank, previous_rank, cast(abs(rank_change) as varchar), rank, 1 from ranked where rank <= 10 and abs(rank_change) >= 2
  union all select round_time, 'leader_changed', sector_code, rank, previous_rank, leader, rank, 2 from ranked where rank <= 5 and previous_rank <= 5 and leader <> previous_leader)"""
TARGETS = """select * from (with last as (select * from (select *, row_number() over (partition by stock_code order by quote_time desc) as k from quotes) where k = 1),
p as (select stock_code, cast(stock_code as integer) as n from last),
m as (select stock_code, 'pool:p' || (n % 5) as reason, n % 9 * 100 as priority, case n % 3 when 0 then 0 when 1 then 1 else 2 end as lane from p where n % 5 <> 4
  union all select stock_code, 'pool:q', 500, case when n % 7 = 0 then 0 else 2 end from p
  union all (select stock_code, 'strong', 1000, 1 from last order by abs(change_pct) desc, amount_yuan desc, stock_code limit 12)),
t as (select stock_code, first(reason order by priority, lane, reason) as reason, min(priority) as priority, min(lane) as lane from m group by 1),
s as (select t.*, round(abs(change_pct) + least(20, log10(greatest(1, amount_yuan)) - 5), 4) as score from t join last using (stock_code) where lane < 2),
o as (select *, lane = 0 and row_number() over (partition by lane order by priority, score desc, stock_code) > 15 as overflow from s),
w as (select *, case when lane = 0 and not overflow then 'hot' else 'warm' end as target from o)
select stock_code, reason, priority, target, score, overflow, row_number() over (partition by target order by lane, priority, score desc, stock_code) as place from w)"""
NOW, FRESH = "2024-01-10 12:00:00", 6 * 3600
LATEST = f"(select * from (select *, row_number() over (partition by stock_code order by quote_time desc) as n from quotes where quote_time <= timestamp '{NOW}') where n = 1)"
_AGE = f"coalesce(epoch(timestamp '{NOW}') - floor(epoch({{}})) > {FRESH}, true)"
_ASK = "d.last_price * (1 + 1 * 0.001::double)"
ENTRY = f"""select *, case reason when 'entry_confirmation_matched' then 'trigger' when 'gap_above_range' then 'reject' when 'near_limit_up_queue' then 'reject' else 'wait' end as decision from (
  select a.stock_code, entry_mode, case when {_AGE.format('q.quote_time')} then 'quote_stale_or_missing' when {_AGE.format('d.round_time')} then 'depth_stale_or_missing' when entry_mode = 'auction' and coalesce(s.n, 0) < 3 then 'auction_depth_history_insufficient' when entry_mode = 'intraday' and coalesce(b.n, 0) < 5 then 'minute_history_insufficient'
    when ({_ASK} / q.pre_close_price - 1) * 100 < -2 then 'gap_below_range' when ({_ASK} / q.pre_close_price - 1) * 100 > 4 then 'gap_above_range' when {_ASK} >= q.limit_up * 0.9998::double then 'near_limit_up_queue' else 'entry_confirmation_matched' end as reason
  from (select distinct stock_code, case cast(stock_code as integer) % 3 when 0 then 'auction' when 1 then 'open' else 'intraday' end as entry_mode from quotes) a left join {LATEST} q on q.stock_code = a.stock_code
  left join (select * from (select *, row_number() over (partition by stock_code order by round_time desc) as n from quotes where round_time <= timestamp '{NOW}') where n = 1) d on d.stock_code = a.stock_code
  left join (select stock_code, count(*) as n from quotes where round_time <= timestamp '{NOW}' and cast(round_time as date) = date '{NOW[:10]}' group by 1) s on s.stock_code = a.stock_code
  left join (select stock_code, count(*) as n from minutes where bar_time <= timestamp '{NOW}' and cast(bar_time as date) = date '{NOW[:10]}' group by 1) b on b.stock_code = a.stock_code)"""
POOLS = "select distinct stock_code, case when cast(stock_code as integer) % 3 = 0 then 'watch' else 'core' end as pool from quotes union all select distinct stock_code, 'all' from quotes"
ALL = {"grp": GROUPS, "pools": POOLS, "strength": STRENGTH, "points": POINTS, "ranked": RANKED, "board": BOARD, "line": LINE, "f1": Q.F1}
_AT = "max(case when n = {} then price end)"
TABLE = {
    "x01_accepted_rounds": (lambda s, d: X.accepted(D.quotes(s, d), active(s, d), 0.12), "select round_time, received, active, received >= ceil(active * 0.12) as accepted from (select round_time, count(distinct stock_code) as received, (select count(distinct stock_code) from quotes) as active from quotes group by 1)"),
    "x02_overview": (overview, OVERVIEW),
    "x03_above_ma": (lambda s, d: X.above_ma(D.quotes(s, d), latest_factors(s, d)), "select round_time, count(*) filter (last_price >= ma5) as above_ma5, count(*) filter (last_price >= ma20) as above_ma20, count(*) filter (last_price >= ma60) as above_ma60, count(*) filter (last_price >= ma5 and last_price >= ma20 and last_price >= ma60) as above_all, count(*) as compared from quotes q join (select * from (select *, row_number() over (partition by stock_code order by trade_date desc) as latest from f1) where latest = 1) f on f.stock_code = q.stock_code group by 1"),
    "x04_intraday_structure": (lambda s, d: X.intraday_structure(D.quotes(s, d)), "select round_time, count(*) filter (last_price > open_price) as above_open, count(*) filter (last_price < open_price) as below_open, count(*) filter (abs(last_price - high_price) <= greatest(0.001, high_price * 0.0002::double)) as at_high, count(*) filter (abs(last_price - low_price) <= greatest(0.001, low_price * 0.0002::double)) as at_low from quotes group by 1"),
    "x05_limit_hits": (lambda s, d: X.limit_hits(D.quotes(s, d)), "select round_time, count(*) filter (abs(limit_up - last_price) <= greatest(0.001, limit_up * 0.0002::double)) as limit_ups, count(*) filter (abs(limit_down - last_price) <= greatest(0.001, limit_down * 0.0002::double)) as limit_downs, count(*) as verified from quotes group by 1"),
    "c34_published": (lambda s, d: X.overview(X.accepted_rows(D.quotes(s, d), active(s, d), 0.12)).select("round_time", "quotes", "up", "down"), "select round_time, count(*) as quotes, count(*) filter (change_pct > 0) as up, count(*) filter (change_pct < 0) as down from quotes q group by 1 having count(distinct stock_code) >= ceil((select count(distinct stock_code) from quotes) * 0.12)"),
    "x06_sector_strength": (sector_strength, "select * from strength"),
    "x08_rank_delta": (ranked, "select * exclude (point, trade_date) from ranked"),
    "x10_change_events": (change_events, EVENTS),
    "x11_changed_quotes": (lambda s, d: X.changed_quotes(D.quotes(s, d)).select("stock_code", "round_time"), "select stock_code, round_time from (select *, lag((quote_time, last_price, change_pct, volume_share, amount_yuan)) over (partition by stock_code order by round_time) as p from quotes) where p is distinct from (quote_time, last_price, change_pct, volume_share, amount_yuan)"),
    "x12_depth_features": (lambda s, d: X.depth_features(depth(s, d)), "select stock_code, round_time as depth_time, 15.0::double * volume_share as bid_volume, a as ask_volume, round((15 * volume_share - a) / (15 * volume_share + a), 6) as imbalance, round(last_price * (1 + 1 * 0.001::double) - last_price * (1 - 1 * 0.001::double), 6) as spread, round((last_price * (1 + 0.001::double) - last_price * (1 - 0.001::double)) / ((last_price * (1 + 0.001::double) + last_price * (1 - 0.001::double)) / 2) * 100, 6) as spread_pct from (select *, cast(volume_share * ((hour(round_time) % 5 + 1) * (hour(round_time) % 5 + 2) / 2) as double) as a from quotes)"),
    "x13_last_depths": (lambda s, d: X.last_depths(depth(s, d)).select("stock_code", "depth_time"), "select stock_code, round_time as depth_time from (select *, row_number() over (partition by stock_code order by round_time desc) as n from quotes) where n <= 3"),
    "x14_minute_features": (lambda s, d: X.minute_features(D.minutes(s, d)), f"select stock_code, trade_date, ({_AT.format(1)} / {_AT.format(2)} - 1) * 100 as return_1m, ({_AT.format(1)} / {_AT.format(6)} - 1) * 100 as return_5m, ({_AT.format(1)} / {_AT.format(16)} - 1) * 100 as return_15m, round((sum(volume_hand) filter (n <= 5) / count(*) filter (n <= 5)) / nullif(sum(volume_hand) filter (n between 6 and 25) / nullif(count(*) filter (n between 6 and 25), 0), 0), 6) as volume_spike, ({_AT.format(1)} / arg_max(price, n) - 1) * 100 as trend, ({_AT.format(1)} - min(price)) / nullif(max(price) - min(price), 0) as strength, {_AT.format(1)} >= max(price) as breakout from (select *, row_number() over (partition by stock_code, trade_date order by bar_time desc, event_id desc) as n from minutes) group by 1, 2"),
    "x15_merge_targets": (targets, TARGETS),
    "x16_in_session": (lambda s, d: D.table(s, d, "events").filter(X.in_session(F.col("ts"))).select("event_id"), "select event_id from (select *, ts + interval 8 hour as l from events) where dayofweek(l) between 1 and 5 and (cast(l as time) between time '09:30:00' and time '11:30:00.999999' or cast(l as time) between time '13:00:00' and time '15:00:00.999999')"),
    "x07_pool_summary": (lambda s, d: X.strength(D.quotes(s, d), pools(s, d), "pool"), STRENGTH.replace("sector_code", "pool").replace(" grp", " pools")),
    "x09_timeline": (lambda s, d: X.timeline(D.quotes(s, d), active(s, d), LEAST), "select * from line"),
    "x17_entry_triggers": (lambda s, d: X.entry_triggers(entry_candidates(s, d), D.quotes(s, d), depth(s, d), D.minutes(s, d), NOW, FRESH, FRESH), ENTRY),
    "x16_opening_depth": (lambda s, d: D.table(s, d, "events").filter(X.in_session(F.col("ts"), "opening_depth")).select("event_id"), "select event_id from (select *, ts + interval 8 hour as l from events) where dayofweek(l) between 1 and 5 and cast(l as time) between time '09:20:00' and time '09:25:00.999999'"),
    "x18_exit_triggers": (lambda s, d: X.exit_triggers(held(s, d), max_age=3600), None),
    "x20_fresh_quotes": (lambda s, d: X.drop_stale(D.quotes(s, d), NOW, FRESH).select("stock_code", "quote_time"), f"select stock_code, quote_time from quotes where epoch(timestamp '{NOW}') - floor(epoch(quote_time)) <= {FRESH}"),
    "j14_latest_state": (lambda s, d: latest_state(active(s, d), D.quotes(s, d), NOW, FRESH), f"select a.stock_code, quote_time, last_price, coalesce(epoch(timestamp '{NOW}') - floor(epoch(quote_time)) <= {FRESH}, false) as fresh from (select distinct stock_code from quotes) a left join {LATEST} q on q.stock_code = a.stock_code"),
    "x19_dedupe_events": (lambda s, d: X.dedupe_events(D.table(s, d, "events"), ["user_id", "event_type"], "ts").select("user_id", "event_type"), "select distinct user_id, event_type from events"),
}
QUERIES = {name: entry[0] for name, entry in TABLE.items()}
ORACLES = {name: with_frames(entry[1], **ALL) for name, entry in TABLE.items() if entry[1]}
