"""Registered queries of ingest, merge, reads, joins, set operations, quality and pools, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest as G
from ..operators import insight as I
from ..operators import merge as U
from ..operators import quality as A
from ..operators import relational as R
from ..sources import domain as D
from . import factor_queries as Q
from . import strategy_queries as S
from .oracle import with_frames

KEY = ["stock_code", "trade_date"]


def s_(c):
    return F.col(c).cast("string")


def raw_daily(spark, d):
    """Bars as a vendor sends them: text, thousands, some rows blank or without a date."""
    b = D.bars(spark, d)
    n = F.dayofmonth("trade_date")
    date = F.when(n == 13, "").when(n % 2 == 0, F.date_format("trade_date", "yyyyMMdd")).otherwise(F.date_format("trade_date", "yyyy-MM-dd"))
    return b.select(F.concat("stock_code", F.lit(".SZ")).alias("ts_code"), date.alias("trade_date"), *[s_(f"{c}_price").alias(c) for c in ("open", "high", "low", "close")], F.when(n == 7, " ").otherwise(s_("pre_close_price")).alias("pre_close"), s_("volume_hand").alias("vol"), (F.col("amount_yuan") / 1000).cast("string").alias("amount"), s_("change_pct").alias("pct_chg"), (F.col("close_price") - F.col("pre_close_price")).cast("string").alias("change"))


def raw_flow(spark, d):
    f = D.flow(spark, d)
    out = f.select(F.concat("stock_code", F.lit(".SH")).alias("ts_code"), F.date_format("trade_date", "yyyyMMdd").alias("trade_date"), s_("main_net_inflow").alias("net_mf_amount"), *[x for k, c in (("sm", "main_net_inflow"), ("md", "big_order_net_inflow"), ("lg", "super_large_net_inflow"), ("elg", "main_net_inflow")) for x in (s_(c).alias(f"buy_{k}_amount"), F.when(F.dayofmonth("trade_date") != 5, F.lit("100")).alias(f"sell_{k}_amount"))])
    return out


def raw_events(spark, d):
    e = D.limit_events(spark, d).filter("event_type <> 'suspend'")
    n = F.dayofmonth("trade_date")
    flag = F.when(F.col("event_type") == "limit_up", F.when(n % 3 == 0, "").otherwise("U")).when(F.col("event_type") == "limit_down", "D").when(n % 2 == 0, "Z").otherwise("X")
    return e.select(F.concat("stock_code", F.lit(".SH")).alias("ts_code"), F.date_format("trade_date", "yyyy/MM/dd").alias("trade_date"), F.when(n % 5 == 1, " ").otherwise(flag).alias("limit"), flag.alias("limit_type"), F.when(F.col("event_type") == "limit_up", "1/1").alias("up_stat"), F.when(n % 2 == 0, s_("open_count")).alias("open_times"), s_("open_count").alias("open_count"), s_("limit_price").alias("limit_price"), F.when(n % 2 == 0, F.col("first_time")).otherwise(F.regexp_replace("first_time", "^0|:", "")).alias("first_time"), F.lit("9:3").alias("last_time"))


def raw_master(spark, d):
    n = F.col("s_suppkey")
    return D.table(spark, d, "supplier").select(F.concat(F.element_at(F.array(*map(F.lit, ("6", "0", "3", "8", "920", "5"))), (n % 6 + 1).cast("int")), F.lpad(n.cast("string"), 5, "0"), F.lit(".XX")).alias("ts_code"), F.concat(F.when(n % 11 == 0, "*ST").when(n % 17 == 0, "ST").otherwise(""), F.lit("N"), n.cast("string"), F.when(n % 13 == 0, "退").otherwise("")).alias("name"), F.when(n % 7 == 0, "P").when(n % 23 == 0, "D").otherwise("L").alias("list_status"), F.lit("20200106").alias("list_date"))


def holidays(spark, d):
    return D.table(spark, d, "orders").filter("o_orderkey % 97 = 0").select(F.col("o_orderdate").cast("date").alias("day")).distinct()


def years(spark, d):
    y = F.year("o_orderdate")
    return D.table(spark, d, "orders").agg(F.min(y).alias("first_year"), F.max(y).alias("last_year"))


def sector_map(spark, d):
    return D.table(spark, d, "part").select(F.col("p_brand").alias("raw_code")).distinct().withColumn("sector_code", F.concat(F.lit("ths_concept_"), F.col("raw_code"))).filter("raw_code < 'Brand#4'")


def raw_sector(spark, d):
    return Q.f06(spark, d).select(F.col("sector_code").alias("ts_code"), F.date_format("trade_date", "yyyyMMdd").alias("trade_date"), s_("mean_change").alias("close"), s_("mean_change").alias("pct_change"), s_("net_inflow").alias("net_amount"), F.lit(" ").alias("lead_stock"), F.lit("x").alias("name"))


def multi(spark, d):
    """Bars three times, of sources with different priorities and times."""
    b = D.bars(spark, d).select(*KEY, "close_price")
    parts = [b.filter(cond).withColumns({"source": F.lit(s), "updated_at": F.expr(f"timestamp'2022-06-01' + make_interval(0, 0, 0, {k} * dayofmonth(trade_date))"), "close_price": F.col("close_price") + k}) for k, (s, cond) in enumerate((("primary", "dayofmonth(trade_date) % 3 <> 0"), ("secondary", "true"), ("legacy", "true")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


MULTI = " union all ".join(f"select stock_code, trade_date, close_price + {k} as close_price, '{s}' as source, timestamp '2022-06-01' + to_days(cast({k} * day(trade_date) as integer)) as updated_at from bars where {c}" for k, (s, c) in enumerate((("primary", "day(trade_date) % 3 <> 0"), ("secondary", "true"), ("legacy", "true"))))


def old_new(spark, d):
    b = D.bars(spark, d).select(*KEY, "close_price")
    return b.filter("dayofmonth(trade_date) <= 20"), b.filter("dayofmonth(trade_date) >= 15").withColumn("close_price", F.col("close_price") + F.when(F.dayofmonth("trade_date") % 2 == 0, 1).otherwise(0))


def snaps(spark, d):
    m = D.members(spark, d).withColumn("n", F.substring("stock_code", 5, 2).cast("int"))
    cur = m.filter("n % 4 <> 0").select("sector_code", "stock_code", F.col("n").alias("weight"))
    new = m.filter("n % 5 <> 0").select("sector_code", "stock_code", (F.col("n") + F.when(F.col("n") % 3 == 0, 1).otherwise(0)).alias("weight"))
    return cur, new


def grid_parts(spark, d):
    """Every open day, the stocks, and where they are suspended."""
    return D.calendar(spark, d), D.stocks(spark, d), D.limit_events(spark, d).filter("event_type = 'suspend'")


def assets(spark, d):
    return {"bars": D.bars(spark, d), "basic": D.basic(spark, d), "flow": D.flow(spark, d)}


def cov(spark, d):
    days, st, off = grid_parts(spark, d)
    return A.coverage(assets(spark, d), days, st, off)


#: Open days that an asset may be behind.
LAGS = {"flow": 1}


def ready_counts(spark, d):
    """By day: rows of each block that the tables stand for, and what they are measured by."""
    more = A.asset_counts({"adjust": D.adjust(spark, d), "factors": Q.f01(spark, d).filter("ma20 is not null")})
    df = A.asset_counts(assets(spark, d)).join(more, "trade_date", "left").join(D.bars(spark, d).filter(F.col("stock_code").isin("000001", "000002")).groupBy("trade_date").agg(F.count("*").alias("index")), "trade_date", "left")
    f6 = Q.f06(spark, d)
    df = df.join(f6.groupBy("trade_date").agg(F.count("*").alias("sector_bars"), F.count("net_inflow").alias("sector_factors")), "trade_date", "left")
    fed = audit(spark, d).filter("status <> 'failed'").groupBy("trade_date").agg((F.count_if(F.col("capability").isin("limit_list", "suspend")) == 2).alias("events_captured"), (F.count_if(F.col("capability") == "stk_limit") == 1).alias("lhb_captured"))
    n = A.active_stocks(D.stocks(spark, d)).agg(F.count("*").alias("active")).crossJoin(D.members(spark, d).agg(F.countDistinct("sector_code").alias("sectors")))
    return df.join(fed, "trade_date", "left").crossJoin(F.broadcast(n)).withColumn("indexes", F.lit(2))  # one row


def raw_depth(spark, d):
    """Depths as a feed has them: JSON arrays of [price, volume], some levels empty, and more than five of them."""
    level = lambda sign: F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.array((F.col("last_price") * (1 + sign * i * 0.001)).cast("double"), F.when((F.hour("round_time") + i) % 4 == 0, 0.0).otherwise(F.col("volume_share") * i).cast("double")))
    return D.quotes(spark, d).select("stock_code", F.col("round_time").alias("depth_time"), F.to_json(level(-1)).alias("bids"), F.when(F.hour("round_time") % 6 != 0, F.to_json(level(1))).alias("asks"))


def depth(spark, d):
    """By side: levels kept, the first of them, and the volume of all."""
    df = G.normalize_depth(raw_depth(spark, d))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x["volume"])
    one = lambda c: [F.size(c).cast("long").alias(f"{c}_n"), F.get(c, F.lit(0))["level"].cast("long").alias(f"{c}_first"), F.get(c, F.lit(0))["price"].alias(f"{c}_price"), total(c).alias(f"{c}_volume")]
    return df.select("stock_code", "depth_time", *one("bids"), *one("asks"))


def audit(spark, d):
    return D.calendar(spark, d).select("trade_date", F.explode(F.array(*map(F.lit, ("limit_list", "stk_limit", "suspend")))).alias("capability"), (F.col("idx") % 5).alias("k")).select("trade_date", "capability", F.when((F.col("k") == 0) & (F.col("capability") == "suspend"), "complete_zero").when((F.col("k") == 1) & (F.col("capability") == "stk_limit"), "failed").otherwise("captured").alias("status"))


def members_named(spark, d):
    return D.members(spark, d).join(D.stocks(spark, d).select("stock_code", "stock_name"), "stock_code")


def v_snapshot(spark, d):
    b = D.bars(spark, d).join(D.stocks(spark, d).select("stock_code", "industry"), "stock_code").select("industry", "trade_date", "stock_code")
    times = F.when(F.col("stock_code") <= "000010", 2).otherwise(1)
    return b.withColumn("_n", F.explode(F.sequence(F.lit(1), times))).drop("_n")  # no union, so that rows stay where their stock is


def _nulls(*columns):
    """Columns that the feed lacks, in SQL."""
    return ", ".join(f"cast(null as double) as {c}" for c in columns)


ELIGIBLE = "select stock_code from stocks where status = 'active' and not is_st and exchange in ('SH', 'SZ')"
B = "select stock_code, trade_date, close_price from bars"
N_ = "cast(substr(stock_code, 5, 2) as integer)"
CUR = f"select sector_code, stock_code, {N_} as weight from members where {N_} % 4 <> 0"
NEW = f"select sector_code, stock_code, {N_} + case when {N_} % 3 = 0 then 1 else 0 end as weight from members where {N_} % 5 <> 0"
GRID = "select s.stock_code, c.trade_date from stocks s cross join calendar c where status = 'active'"
OFF = "select distinct stock_code, trade_date from limit_events where event_type = 'suspend'"
COV = " union all ".join(f"select trade_date, '{n}' as asset, count(*) as expected, count(a) as actual, count(*) filter (a is null and o) as suspended, count(*) - count(a) - count(*) filter (a is null and o) as missing, count(a) / count(*) * 100 as completeness, (count(a) + count(*) filter (a is null and o)) / count(*) * 100 as effective from grid g left join (select distinct stock_code, trade_date, 1 as a from {n}) using (stock_code, trade_date) left join (select *, true as o from off) using (stock_code, trade_date) group by 1" for n in ("bars", "basic", "flow"))
STATS = " union all ".join(f"select '{n}' as asset, count(*) as rows, max(trade_date) as latest, (select count(distinct stock_code) from {n} where trade_date = (select max(trade_date) from {n})) as stocks_at_latest from {n}" for n in ("bars", "basic", "flow"))
COUNTS = "select trade_date, count(distinct stock_code) filter (asset = 'bars') as bars, count(distinct stock_code) filter (asset = 'basic') as basic, count(distinct stock_code) filter (asset = 'flow') as flow from (select stock_code, trade_date, 'bars' as asset from bars union all select stock_code, trade_date, 'basic' from basic union all select stock_code, trade_date, 'flow' from flow) group by 1"
READY = """select trade_date, case when concat(b, a, v, w, i, f) <> '' then 'blocked' when concat(e, l, sb, sf) <> '' then 'degraded' else 'complete' end as status, concat_ws(',', nullif(b, ''), nullif(a, ''), nullif(v, ''), nullif(w, ''), nullif(i, ''), nullif(f, ''), nullif(e, ''), nullif(l, ''), nullif(sb, ''), nullif(sf, '')) as missing from (
  select c.trade_date, case when bars / (select count(*) from stocks where status = 'active') < 0.95 then 'bars' else '' end as b, case when basic / greatest(1, bars) < 0.95 then 'basic' else '' end as a, case when flow / greatest(1, bars) < 0.95 then 'flow' else '' end as v, case when coalesce(j.n, 0) / greatest(1, bars) < 0.95 then 'adjust' else '' end as w,
    case when coalesce(x.n, 0) / 2 < 0.85 then 'index' else '' end as i, case when coalesce(y.n, 0) / greatest(1, bars) < 0.95 then 'factors' else '' end as f, case when k % 5 is null then 'events' else '' end as e, case when coalesce(k % 5 = 1, true) then 'lhb' else '' end as l, case when coalesce(z.n, 0) / (select count(distinct sector_code) from members) < 0.9 then 'sector_bars' else '' end as sb, case when coalesce(z.m, 0) = 0 then 'sector_factors' else '' end as sf
  from counts c left join (select trade_date, count(distinct stock_code) as n from adjust group by 1) j on j.trade_date = c.trade_date left join (select trade_date, count(*) as n from bars where stock_code in ('000001', '000002') group by 1) x on x.trade_date = c.trade_date left join (select trade_date, count(distinct stock_code) as n from f1 where ma20 is not null group by 1) y on y.trade_date = c.trade_date
  left join (select trade_date, count(*) as n, count(net_inflow) as m from f6 group by 1) z on z.trade_date = c.trade_date left join (select trade_date, idx as k from calendar) q on q.trade_date = c.trade_date)"""
CATALOG = "select 'concept' as kind, sector_code as name, count(distinct stock_code) as n from members group by 1, 2 union all select 'industry', industry, count(*) filter (status = 'active') from stocks group by 1, 2"
RAWM = "select *, case s_suppkey % 6 when 0 then '6' when 1 then '0' when 2 then '3' when 3 then '8' when 4 then '920' else '5' end || lpad(cast(s_suppkey as varchar), 5, '0') as code, case when s_suppkey % 11 = 0 then '*ST' when s_suppkey % 17 = 0 then 'ST' else '' end || 'N' || s_suppkey || case when s_suppkey % 13 = 0 then '退' else '' end as nm from supplier"
ALL = S.ALL | {"cur_members": CUR, "new_members": NEW, "grid": GRID, "off": OFF, "coverage": COV, "stats": STATS, "counts": COUNTS, "catalog": CATALOG, "multi": MULTI, "rawm": RAWM, "f6": Q.F6}
TABLE = {
    "c01_daily_bars": (lambda s, d: G.normalize_daily(raw_daily(s, d), D.stocks(s, d).filter("not is_st")), "select stock_code, trade_date, open_price, high_price, low_price, close_price, case when day(trade_date) <> 7 then pre_close_price end as pre_close_price, volume_hand, volume_hand * 100 as volume_share, amount_yuan / 1000 * 1000 as amount_yuan, close_price - pre_close_price as change_amount, change_pct from bars where day(trade_date) <> 13 and stock_code in (select stock_code from stocks where not is_st)"),
    "c02_daily_basic": (lambda s, d: G.normalize_daily_basic(D.basic(s, d).select(F.col("stock_code").alias("ts_code"), s_("trade_date").alias("trade_date"), s_("turnover_rate").alias("turnover_rate"), s_("pe").alias("pe"), s_("total_mv").alias("total_mv"))), "select stock_code, trade_date, turnover_rate, pe, total_mv, " + _nulls(*[c for c in G.BASIC if c not in ("turnover_rate", "pe", "total_mv")]) + " from basic"),
    "c03_moneyflow": (lambda s, d: G.normalize_moneyflow(raw_flow(s, d)), "select stock_code, trade_date, main_net_inflow * 10000 as main_net_inflow, " + ", ".join(f"{c} * 10000 as {n}_buy_amount, case when day(trade_date) <> 5 then 1000000.0::double end as {n}_sell_amount, case when day(trade_date) <> 5 then {c} * 10000 - 1000000 end as {net}" for n, net, c in (("small", "small_net_inflow", "main_net_inflow"), ("medium", "medium_net_inflow", "big_order_net_inflow"), ("large", "big_order_net_inflow", "super_large_net_inflow"), ("super_large", "super_large_net_inflow", "main_net_inflow"))) + " from flow"),
    "c04_adj_factor": (lambda s, d: G.normalize_adj_factor(D.adjust(s, d).select(F.col("stock_code").alias("ts_code"), s_("trade_date").alias("trade_date"), F.when(F.dayofmonth("trade_date") != 9, s_("adj_factor")).alias("adj_factor"))), "select stock_code, trade_date, adj_factor from adjust where day(trade_date) <> 9"),
    "c05_limit_events": (lambda s, d: G.normalize_limit_events(raw_events(s, d)), "select stock_code, trade_date, case event_type when 'limit_break' then case when day(trade_date) % 2 = 0 then 'limit_break' else 'limit_event' end else event_type end as event_type, cast(open_count as bigint) as open_count, limit_price, first_time, cast(null as varchar) as last_time, " + _nulls("close_price", "turnover_amount") + " from limit_events where event_type <> 'suspend'"),
    "c06_suspensions": (lambda s, d: G.normalize_limit_events(raw_events(s, d)).unionByName(G.normalize_suspensions(D.limit_events(s, d).filter("event_type = 'suspend'").select(F.col("stock_code").alias("ts_code"), s_("trade_date").alias("trade_date")))).groupBy("event_type").agg(F.count("*").alias("n")), "select case event_type when 'limit_break' then case when day(trade_date) % 2 = 0 then 'limit_break' else 'limit_event' end else event_type end as event_type, count(*) as n from limit_events group by 1"),
    "c07_index_daily": (lambda s, d: G.normalize_index_daily(raw_daily(s, d), ["000001.SZ", "000002.SZ"]), "select stock_code || '.SZ' as index_code, trade_date, open_price, high_price, low_price, close_price, cast(volume_hand as double) as volume, change_pct, amount_yuan / 1000 * 1000 as amount_yuan from bars where day(trade_date) <> 13 and stock_code in ('000001', '000002')"),
    "c08_index_basic": (lambda s, d: G.normalize_units_kept(raw_daily(s, d), "ts_code", ["vol", "amount"]), "select stock_code || '.SZ' as ts_code, trade_date, cast(volume_hand as double) as vol, amount_yuan / 1000 as amount from bars where day(trade_date) <> 13"),
    "c09_sector_bar": (lambda s, d: G.normalize_sector_bar(raw_sector(s, d), sector_map(s, d)), "select case when sector_code < 'Brand#4' then 'ths_concept_' else 'ths_' end || sector_code as sector_code, trade_date, mean_change as close_price, mean_change as change_pct, " + _nulls("open_price", "high_price", "low_price", "pre_close_price", "change_amount", "volume", "turnover_rate", "amount_yuan") + " from f6"),
    "c10_sector_flow": (lambda s, d: G.normalize_sector_flow(raw_sector(s, d), sector_map(s, d)), "select case when sector_code < 'Brand#4' then 'ths_concept_' else '' end || sector_code as sector_code, trade_date, net_inflow * 10000 as main_net_inflow, cast(null as varchar) as lead_stock from f6"),
    "c11_dragon_tiger": (lambda s, d: G.normalize_lhb(D.flow(s, d).filter("big_order_net_inflow > 0").select(F.col("stock_code").alias("ts_code"), s_("trade_date").alias("trade_date"), F.when(F.dayofmonth("trade_date") % 2 == 0, "volume").alias("reason"), s_("big_order_net_inflow").alias("net_amount"), s_("main_net_inflow").alias("l_buy"), F.concat(F.lit("N"), "stock_code").alias("name"))), "select stock_code, 'N' || stock_code as stock_name, trade_date, main_net_inflow * 10000 as buy_amount, " + _nulls("close_price", "change_pct", "turnover_amount", "sell_amount") + ", case when day(trade_date) % 2 = 0 then 'volume' else 'unspecified' end as reason, big_order_net_inflow * 10000 as net_buy_amount from flow where big_order_net_inflow > 0"),
    "c12_technical_map": (lambda s, d: G.normalize_technical(raw_daily(s, d).select("ts_code", "trade_date", "pre_close", "close")).select(*KEY, F.size("factors").cast("long").alias("n"), F.col("factors")["close"].alias("close")), "select stock_code, trade_date, 1 + (case when day(trade_date) <> 7 and pre_close_price is not null then 1 else 0 end)::bigint as n, close_price as close from bars where day(trade_date) <> 13"),
    "c13_north_flow": (lambda s, d: G.normalize_north_flow(D.flow(s, d).groupBy("trade_date").agg(F.max("main_net_inflow").alias("m")).select(s_("trade_date").alias("trade_date"), s_("m").alias("hgt"), F.lit("").alias("sgt"), s_("m").alias("north_money")), D.calendar(s, d).filter("idx > 100")), "select trade_date, max(main_net_inflow) as hgt, cast(null as double) as sgt, max(main_net_inflow) as north_money, 'vendor' as value_unit from flow where trade_date in (select trade_date from calendar where idx > 100) group by 1"),
    "c14_topics": (lambda s, d: G.normalize_topic(D.table(s, d, "orders").select(F.concat(s_("o_custkey"), F.lit(".SZ")).alias("ts_code"), F.date_format("o_orderdate", "yyyyMMdd").alias("end_date"), s_("o_totalprice").alias("revenue"), F.lit("1").alias("n_income"), "o_orderkey"), "income", "o_orderkey"), "select cast(o_custkey as varchar) as ts_code, cast(o_orderdate as date) as end_date, arg_max(o_totalprice, o_orderkey) as revenue, 1.0::double as n_income from orders group by 1, 2"),
    "c15_stock_master": (lambda s, d: G.normalize_stock_master(raw_master(s, d)), "select code as stock_code, nm as stock_name, case when code[1] in ('8') or code like '920%' then 'excluded' when s_suppkey % 7 <> 0 and s_suppkey % 23 = 0 or s_suppkey % 13 = 0 then 'delisted' when s_suppkey % 7 = 0 then 'suspended' else 'active' end as status, nm like '*ST%' or nm like 'ST%' as is_st, date '2020-01-06' as list_date from rawm where code[1] <> '5'"),
    "c16_master_merge": (lambda s, d: G.merge_master(D.stocks(s, d).filter("stock_code > '000020'").select("stock_code", F.when(~F.col("is_st"), F.col("stock_name")).alias("stock_name"), "status", F.when(F.col("exchange") == "SH", "exchange").otherwise("other").alias("source")), D.stocks(s, d).filter("stock_code < '000080'").select("stock_code", F.lit("old").alias("stock_name"), F.when(F.col("region_key") == 1, "delisted").otherwise("active").alias("status"))), "select coalesce(n.stock_code, o.stock_code) as stock_code, coalesce(n.stock_name, o.stock_name) as stock_name, case when o.status = 'delisted' and not coalesce(n.source = 'exchange', false) then o.status else coalesce(n.status, o.status) end as status from (select stock_code, case when not is_st then stock_name end as stock_name, status, case when exchange = 'SH' then 'exchange' else 'other' end as source from stocks where stock_code > '000020') n full join (select stock_code, 'old' as stock_name, case when region_key = 1 then 'delisted' else 'active' end as status from stocks where stock_code < '000080') o on n.stock_code = o.stock_code"),
    "c17_quotes": (lambda s, d: G.normalize_quotes(D.quotes(s, d).select(F.col("stock_code").alias("ts_code"), s_("last_price").alias("last_price"), F.when(F.hour("round_time") != 3, s_("pre_close_price")).otherwise("0").alias("pre_close"), F.lit(None).cast("string").alias("change"), F.lit("").alias("pct"))).groupBy("stock_code").agg(F.count("*").alias("n"), F.count("change_pct").alias("with_change"), F.max("change_pct").alias("top"), F.min("change_amount").alias("low")), "select stock_code, count(*) as n, count(*) filter (hour(round_time) <> 3) as with_change, max(change_pct) filter (hour(round_time) <> 3) as top, min(last_price - pre_close_price) filter (hour(round_time) <> 3) as low from quotes group by 1"),
    "c17_depth": (depth, """select stock_code, round_time as depth_time, len(k)::bigint as bids_n, k[1]::bigint as bids_first, last_price * (1 + -1 * k[1] * 0.001::double) as bids_price, coalesce(list_sum(k), 0)::bigint * volume_share as bids_volume,
  case when not z then len(k)::bigint end as asks_n, case when not z then k[1]::bigint end as asks_first, case when not z then last_price * (1 + k[1] * 0.001::double) end as asks_price, case when not z then coalesce(list_sum(k), 0)::bigint * volume_share end as asks_volume
  from (select *, list_filter([1, 2, 3, 4, 5], lambda i: (hour(round_time) + i) % 4 <> 0) as k, hour(round_time) % 6 = 0 as z from quotes)"""),
    "c18_trade_date": (lambda s, d: G.derive_trade_date(D.minutes(s, d).drop("trade_date")).groupBy("trade_date").agg(F.count("*").alias("n")), "select cast(bar_time + interval 8 hour as date) as trade_date, count(*) as n from minutes group by 1"),
    "c19_calendar": (lambda s, d: G.build_calendar(years(s, d), holidays(s, d)), "select x.trade_date, is_open, previous_trade_date, next_trade_date from days x left join (select trade_date, lag(trade_date) over (order by trade_date) as previous_trade_date, lead(trade_date) over (order by trade_date) as next_trade_date from days where is_open) o on o.trade_date = x.trade_date"),
    "c20_upsert": (lambda s, d: (lambda old, new: U.upsert(old, new.unionByName(new.withColumn("close_price", F.col("close_price") - 1)), KEY, [F.desc("close_price")]))(*old_new(s, d)), f"select stock_code, trade_date, close_price + case when day(trade_date) >= 15 and day(trade_date) % 2 = 0 then 1 else 0 end as close_price from bars"),
    "c21_insert_only": (lambda s, d: U.upsert(*old_new(s, d), KEY, [F.desc("close_price")], mode="insert_only"), "select stock_code, trade_date, close_price + case when day(trade_date) > 20 and day(trade_date) % 2 = 0 then 1 else 0 end as close_price from bars"),
    "c22_update_changed": (lambda s, d: U.update_changed(*old_new(s, d), KEY, "close_price"), "select stock_code, trade_date, close_price + case when day(trade_date) >= 15 and day(trade_date) % 2 = 0 then 1 else 0 end as close_price, day(trade_date) >= 15 and day(trade_date) % 2 = 0 as changed from bars where day(trade_date) <= 20"),
    "c23_merge_features": (lambda s, d: (lambda b: U.merge_features(b.select(*KEY, F.create_map(F.lit("a"), F.col("close_price"), F.lit("b"), F.lit(1.0)).alias("features")), b.filter("volume_hand > 100").select(*KEY, F.create_map(F.lit("b"), F.col("open_price")).alias("features")), KEY).select(*KEY, F.col("features")["a"].alias("a"), F.col("features")["b"].alias("b")))(D.bars(s, d)), "select stock_code, trade_date, close_price as a, case when volume_hand > 100 then open_price else 1 end as b from bars"),
    "c24_sync_membership": (lambda s, d: U.sync_membership(*snaps(s, d), ["sector_code", "stock_code"], ["weight"]), "select sector_code, stock_code, case when c.weight is null then 'inserted' when n.weight is null then 'deleted' when c.weight = n.weight then 'unchanged' else 'updated' end as action from cur_members c full join new_members n using (sector_code, stock_code)"),
    "c25_scd2": (lambda s, d: (lambda c, n: U.scd2_apply(c.select("sector_code", "stock_code", F.lit("2020-01-06").cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to")), n, ["sector_code", "stock_code"], "2021-01-04"))(*snaps(s, d)), "select sector_code, stock_code, case when c.weight is null then date '2021-01-04' else date '2020-01-06' end as valid_from, case when n.weight is null then date '2021-01-04' end as valid_to from cur_members c full join new_members n using (sector_code, stock_code)"),
    "c26_complete_snapshot": (lambda s, d: U.latest_complete_snapshot(v_snapshot(s, d), "industry", "trade_date", "stock_code", 4), "select industry, trade_date, stock_code, pruned from (select distinct b.industry, b.trade_date, stock_code from vs b) join (select industry, trade_date, rows - m as pruned from (select *, row_number() over (partition by industry order by m >= 4 desc, trade_date desc) as n from (select industry, trade_date, count(distinct stock_code) as m, count(*) as rows from vs group by 1, 2)) where n = 1) using (industry, trade_date)"),
    "c27_compact": (lambda s, d: U.compact(multi(s, d), KEY, [F.desc("updated_at"), F.col("source")]).groupBy("source", "kept").agg(F.count("*").alias("n")), "select source, n = 1 as kept, count(*) as n from (select *, row_number() over (partition by stock_code, trade_date order by updated_at desc, source) as n from multi) group by 1, 2"),
    "c28_normalize_units": (lambda s, d: U.normalize_units(U.normalize_units(D.flow(s, d).select(*KEY, "main_net_inflow", F.when(F.dayofmonth("trade_date") > 10, "yuan").alias("unit")), ["main_net_inflow"]), ["main_net_inflow"]), "select stock_code, trade_date, case when day(trade_date) > 10 then main_net_inflow else main_net_inflow * 10000 end as main_net_inflow, 'yuan' as unit from flow"),
    "c29_migrate_legacy": (lambda s, d: U.migrate_legacy({"old_daily": D.bars(s, d), "old_qfq": D.bars(s, d).filter("stock_code <= '000010'")}).groupBy("source", "adjust_mode").agg(F.count("*").alias("n")), "select 'old_daily' as source, 'none' as adjust_mode, count(*) as n from bars union all select 'old_qfq', 'qfq', count(*) from bars where stock_code <= '000010'"),
    "c30_retention": (lambda s, d: U.prune(D.bars(s, d), D.calendar(s, d), 20).select(*KEY), "select stock_code, trade_date from bars where trade_date >= (select min(trade_date) from (select trade_date from calendar order by 1 desc limit 20))"),
    "c31_clear_range": (lambda s, d: U.clear_range(D.bars(s, d).select(*KEY), "2020-02-01", "2022-01-31", D.stocks(s, d).filter("is_st").select("stock_code")), "select stock_code, trade_date from bars where not (trade_date between date '2020-02-01' and date '2022-01-31' and stock_code in (select stock_code from stocks where is_st))"),
    "c32_missing_keys": (lambda s, d: U.missing_keys(D.bars(s, d), D.basic(s, d), KEY), "select stock_code, trade_date from bars except select stock_code, trade_date from basic"),
    "c33_completion": (lambda s, d: U.completion(audit(s, d)), "select trade_date, case when idx % 5 = 1 then 'limit_list,suspend' else 'limit_list,stk_limit,suspend' end as capabilities, case when idx % 5 = 0 then 1 else 0 end::bigint as zero_days from calendar"),
    "p01_eligible": (lambda s, d: I.eligible(D.stocks(s, d)).select("stock_code", "exchange"), "select stock_code, exchange from stocks where status = 'active' and not is_st and exchange in ('SH', 'SZ')"),
    "p02_canonical_rows": (lambda s, d: U.canonical_rows(multi(s, d), KEY, ["primary", "secondary"]).select(*KEY, "source", "close_price"), "select stock_code, trade_date, source, close_price from (select *, row_number() over (partition by stock_code, trade_date order by case source when 'primary' then 1 when 'secondary' then 2 else 3 end, updated_at desc) as n from multi) where n = 1"),
    "p03_latest_per_key": (lambda s, d: U.latest_per_key(D.bars(s, d), ["stock_code"], [F.desc("trade_date")]).select(*KEY, "close_price"), "select stock_code, max(trade_date) as trade_date, arg_max(close_price, trade_date) as close_price from bars group by 1"),
    "p04_filter_range": (lambda s, d: R.filter_range(D.bars(s, d), "2020-03-01", "2020-06-30", ["000001", "000002", "000007"]).select(*KEY, "close_price"), B + " where trade_date between date '2020-03-01' and date '2020-06-30' and stock_code in ('000001', '000002', '000007')"),
    "p05_composite_in": (lambda s, d: R.restrict(D.bars(s, d).select(*KEY, "close_price"), Q.ups(s, d)), B + " where (stock_code, trade_date) in (select (stock_code, trade_date) from upd)"),
    "p06_search": (lambda s, d: R.search(D.stocks(s, d), "00002", 20).select("stock_code", "status"), "select stock_code, status from stocks where contains(stock_code, '00002') or contains(lower(stock_name), '00002') order by case when status = 'active' then 0 else 1 end, stock_code limit 20"),
    "p07_search_candidates": (lambda s, d: R.search_candidates(D.stocks(s, d), D.stocks(s, d).filter("is_st"), "00000", 50), "select stock_code, stock_name, case when stock_code like '00000%' then 0 when lower(stock_name) like '00000%' then 1 else 2 end::bigint as rank, is_st as is_member from stocks where contains(stock_code, '00000') or contains(lower(stock_name), '00000') order by rank, stock_code limit 50"),
    "p08_page": (lambda s, d: R.page(D.stocks(s, d).select("stock_code", "industry"), ["stock_code"], 2, 15), "select stock_code, industry, (select count(*) from stocks) as total from stocks order by stock_code limit 15 offset 15"),
    "p09_json_path": (lambda s, d: R.json_path(D.table(s, d, "events"), "props", "$.k", "k").select("event_id", "k"), "select event_id, json_extract_string(props, '$.k') as k from events"),
    "p11_has_any": (lambda s, d: Q.f05(s, d).withColumn("m", F.split("missing", ",")).filter(R.has_any("m", ["ma90", "rsi14"])).select(*KEY), "select stock_code, trade_date from f5 where list_has_any(string_split(missing, ','), ['ma90', 'rsi14'])"),
    "p13_staleness": (lambda s, d: R.staleness(D.bars(s, d), "stock_code", "2022-03-31"), "select stock_code, max(trade_date) as latest, date '2022-03-31' - max(trade_date) as age_days, max(trade_date) < date '2022-03-31' as is_stale from bars group by 1"),
    "p14_resolve_sources": (lambda s, d: R.resolve_sources([("flow", D.flow(s, d).select(*KEY)), ("basic", D.basic(s, d).select(*KEY)), ("bars", D.bars(s, d).select(*KEY))], KEY), "select stock_code, trade_date, case when f then 'flow' when k then 'basic' else 'bars' end as source, concat_ws(',', case when f then 'flow' end, case when k then 'basic' end, 'bars') as attempted from bars b left join (select stock_code, trade_date, true as f from flow) using (stock_code, trade_date) left join (select stock_code, trade_date, true as k from basic) using (stock_code, trade_date)"),
    "p15_daily_fact": (lambda s, d: R.daily_fact(D.bars(s, d), D.basic(s, d), D.flow(s, d)), "select stock_code, trade_date, close_price, turnover_rate, main_net_inflow, round(volume_hand / m, 6) as volume_ratio, turnover_rate is not null as has_basic, main_net_inflow is not null as has_flow, main_net_inflow / greatest(amount_yuan, 1) * 100 as net_ratio from (select *, avg(volume_hand) over (partition by stock_code order by trade_date rows between 5 preceding and 1 preceding) as m from bars) left join basic using (stock_code, trade_date) left join flow using (stock_code, trade_date)"),
    "j02_left_chain": (lambda s, d: D.bars(s, d).select(*KEY).join(D.flow(s, d), KEY, "left").join(D.adjust(s, d), KEY, "left"), "select stock_code, trade_date, main_net_inflow, big_order_net_inflow, super_large_net_inflow, adj_factor from bars left join flow using (stock_code, trade_date) left join adjust using (stock_code, trade_date)"),
    "j03_having_event": (lambda s, d: R.restrict(D.bars(s, d).select(*KEY, "close_price"), D.limit_events(s, d).filter("event_type = 'limit_break'").select(*KEY)), B + " b where exists (select 1 from limit_events e where e.stock_code = b.stock_code and e.trade_date = b.trade_date and event_type = 'limit_break')"),
    "j05_date_universe": (lambda s, d: R.date_universe(D.calendar(s, d), D.stocks(s, d), D.bars(s, d)), "select stock_code, trade_date, b.p is not null as present from (select s.stock_code, c.trade_date from stocks s cross join calendar c) left join (select stock_code, trade_date, 1 as p from bars) b using (stock_code, trade_date)"),
    "j08_last_n": (lambda s, d: R.last_n_agg(D.bars(s, d), 20), "select stock_code, round(avg(close_price), 6) as mean_close, count(*) as rows from (select *, row_number() over (partition by stock_code order by trade_date desc) as n from bars) where n <= 20 group by 1"),
    "j11_forward_path": (lambda s, d: R.forward_path(Q.ups(s, d), D.bars(s, d), D.calendar(s, d), 3), "select u.stock_code, u.trade_date as signal_date, cast(d.idx - c.idx as bigint) as day, b.trade_date, close_price from upd u join calendar c using (trade_date) join calendar d on d.idx between c.idx + 1 and c.idx + 3 join bars b on b.stock_code = u.stock_code and b.trade_date = d.trade_date"),
    "j12_resolve_leader": (lambda s, d: R.resolve_leader(D.members(s, d).join(D.stocks(s, d).select("stock_code", "stock_name", "region_key"), "stock_code").groupBy("sector_code").agg(F.max("stock_name").alias("lead_stock")), members_named(s, d).filter("stock_code < '000090'")), "select sector_code, lead_stock, m.stock_code as leader_code from (select sector_code, max(stock_name) as lead_stock from members join stocks using (stock_code) group by 1) f left join (select sector_code, stock_name as lead_stock, stock_code from members join stocks using (stock_code) where stock_code < '000090') m using (sector_code, lead_stock)"),
    "t01_last_n_dates": (lambda s, d: R.last_n_dates(D.calendar(s, d), 30), "select trade_date from calendar order by 1 desc limit 30"),
    "t03_top_k": (lambda s, d: R.top_k(D.bars(s, d).filter("trade_date = '2021-06-01'").select("stock_code", "change_pct"), "change_pct", 10), "select stock_code, change_pct from bars where trade_date = date '2021-06-01' order by change_pct desc nulls last, stock_code limit 10"),
    "t04_top_k_per": (lambda s, d: R.top_k_per(D.bars(s, d).select(*KEY, "amount_yuan"), ["trade_date"], [F.desc("amount_yuan"), F.col("stock_code")], 3), "select * from (select stock_code, trade_date, amount_yuan, row_number() over (partition by trade_date order by amount_yuan desc, stock_code) as place from bars) where place <= 3"),
    "t05_argmax": (lambda s, d: R.argmax_per(D.bars(s, d), "trade_date", "change_pct", "stock_code"), "select trade_date, first(stock_code order by change_pct desc, stock_code) as leader, first(stock_code order by change_pct, stock_code) as laggard from bars where change_pct is not null group by 1"),
    "t07_buckets": (lambda s, d: R.bucket_counts(D.bars(s, d), "trade_date", "change_pct", [-7.0, -3.0, 0.0, 3.0, 7.0]), "select trade_date, count(*) filter (change_pct < -7) as b0, count(*) filter (change_pct >= -7 and change_pct < -3) as b1, count(*) filter (change_pct >= -3 and change_pct < 0) as b2, count(*) filter (change_pct >= 0 and change_pct < 3) as b3, count(*) filter (change_pct >= 3 and change_pct < 7) as b4, count(*) filter (change_pct >= 7) as b5 from bars group by 1"),
    "u02_union_distinct": (lambda s, d: R.union_distinct(D.bars(s, d).select(*KEY), D.flow(s, d).select(*KEY), D.limit_events(s, d).select(*KEY)), "select stock_code, trade_date from bars union select stock_code, trade_date from flow union select stock_code, trade_date from limit_events"),
    "u04_overlap": (lambda s, d: R.overlap(D.basic(s, d), Q.ups(s, d), KEY), "select count(*) as shared from (select stock_code, trade_date from basic intersect select stock_code, trade_date from upd)"),
    "a10_asset_counts": (lambda s, d: A.asset_counts(assets(s, d)), COUNTS),
    "a11_minute_actual": (lambda s, d: A.minute_actual(D.minutes(s, d)), "select trade_date, count(*) as rows, cast(ceil(count(*) / 240) as bigint) as sessions from minutes group by 1"),
    "p12_trend_history": (lambda s, d: R.trend_history(I.breadth(D.bars(s, d), D.stocks(s, d)), ["up_count", "down_count"], 60), f"select trade_date, count(*) filter (change_pct > 0) as up_count, count(*) filter (change_pct < 0) as down_count from bars where stock_code in ({ELIGIBLE}) group by 1 order by 1 desc limit 60"),
    "p17_stock_overview": (lambda s, d: R.stock_overview(D.stocks(s, d), D.bars(s, d), D.basic(s, d), D.members(s, d)), "select s.stock_code, stock_name, status, b.trade_date as bar_date, close_price, change_pct, v.trade_date as basic_date, turnover_rate, pe, coalesce(n, 0) as sectors from stocks s left join (select * from bars qualify row_number() over (partition by stock_code order by trade_date desc) = 1) b on b.stock_code = s.stock_code left join (select * from basic qualify row_number() over (partition by stock_code order by trade_date desc) = 1) v on v.stock_code = s.stock_code left join (select stock_code, count(distinct sector_code) as n from members group by 1) m on m.stock_code = s.stock_code"),
    "p17_stock_series": (lambda s, d: R.stock_series(D.bars(s, d), Q.f01(s, d).filter("dayofmonth(trade_date) <> 9"), 250), "select b.stock_code, b.trade_date, close_price, ma5, ma20, ma60 from (select * from bars qualify row_number() over (partition by stock_code order by trade_date desc) <= 250) b left join (select stock_code, trade_date, ma5, ma20, ma60 from f1 where day(trade_date) <> 9) f on f.stock_code = b.stock_code and f.trade_date = b.trade_date"),
    "p17_stock_session": (lambda s, d: R.stock_session(D.minutes(s, d).withColumn("trade_date", F.date_sub("trade_date", 730)), D.bars(s, d)).select(*KEY, "event_id", "reference_price"), "select m.stock_code, m.trade_date, event_id, pre_close_price as reference_price from (select *  replace (cast(trade_date - interval 730 day as date) as trade_date) from minutes qualify trade_date = max(trade_date) over (partition by stock_code)) m left join bars b on b.stock_code = m.stock_code and b.trade_date = m.trade_date"),
    "p17_stock_events": (lambda s, d: R.stock_events(D.limit_events(s, d), "2021-12-31", 120, 20).select(*KEY, "event_type"), "select stock_code, trade_date, event_type from limit_events where trade_date between date '2021-12-31' - 120 and date '2021-12-31' qualify row_number() over (partition by stock_code order by trade_date desc, event_type) <= 20"),
    "q08_unit_samples": (lambda s, d: A.unit_samples(D.bars(s, d).select(*KEY).join(D.flow(s, d), KEY, "left")), "select * from (select bucket, row_number() over (partition by bucket order by trade_date desc, stock_code) as place, stock_code, trade_date, main_net_inflow from (select *, case when main_net_inflow is null then 'null' when abs(main_net_inflow) < 10000 then 'below_1e4' when abs(main_net_inflow) < 100000 then 'below_1e5' else 'above' end as bucket from bars left join flow using (stock_code, trade_date))) where place <= 5"),
    "a12_unit_audit": (lambda s, d: A.unit_audit(D.bars(s, d).select(*KEY).join(D.flow(s, d), KEY, "left")), "select case when main_net_inflow is null then 'null' when abs(main_net_inflow) < 10000 then 'below_1e4' when abs(main_net_inflow) < 100000 then 'below_1e5' else 'above' end as bucket, count(*) as n, min(main_net_inflow) as low, max(main_net_inflow) as high, quantile_cont(abs(main_net_inflow), 0.5) as median_size from bars left join flow using (stock_code, trade_date) group by 1"),
    "a13_catalog": (lambda s, d: A.catalog(D.stocks(s, d), D.members(s, d)), CATALOG),
    "q01_coverage": (cov, COV),
    "q02_gaps": (lambda s, d: (lambda g: A.gaps(D.flow(s, d), D.bars(s, d), *g))(grid_parts(s, d)), "select stock_code, trade_date, case when o.x is not null then 'suspended' when b.p is null then 'no_market_record' else 'missing_data' end as reason from grid left join (select *, 1 as x from off) o using (stock_code, trade_date) left join (select stock_code, trade_date, 1 as p from bars) b using (stock_code, trade_date) where (stock_code, trade_date) not in (select (stock_code, trade_date) from flow)"),
    "q03_table_stats": (lambda s, d: A.table_stats(assets(s, d)), STATS),
    "q04_stale_days": (lambda s, d: A.stale_days(A.table_stats({k: v.filter("trade_date < '2022-03-20'") if k == "flow" else v for k, v in assets(s, d).items()}), D.calendar(s, d)), "select asset, latest, (select count(*) from calendar where trade_date > latest) as stale_days from (select asset, case when asset = 'flow' then (select max(trade_date) from flow where trade_date < date '2022-03-20') else latest end as latest from stats)"),
    "q05_asset_summary": (lambda s, d: (lambda st: A.asset_summary(st, A.stale_days(st, D.calendar(s, d)), cov(s, d), LAGS))(A.table_stats(assets(s, d))), "select x.*, missing, case when rows = 0 then 'empty' when stale_days > case x.asset when 'flow' then 1 else 0 end then 'stale' when missing > 0 then 'partial' else 'ok' end as status from (select *, (select count(*) from calendar where trade_date > latest) as stale_days from stats) x left join coverage c on c.asset = x.asset and c.trade_date = x.latest"),
    "q06_daily_health": (lambda s, d: A.daily_health(cov(s, d)), "select trade_date, max(status) filter (asset = 'bars') as bars, max(status) filter (asset = 'basic') as basic, max(status) filter (asset = 'flow') as flow from (select *, case when missing = 0 and effective >= 99.5 then 'ok' when effective >= 98 then 'partial' else 'stale' end as status from coverage) group by 1"),
    "q07_readiness": (lambda s, d: A.readiness(ready_counts(s, d)), READY),
    "q09_duplicate_keys": (lambda s, d: A.duplicate_keys(D.table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]), "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1"),
    "q10_mapping_report": (lambda s, d: G.mapping_report(raw_daily(s, d), G.normalize_daily(raw_daily(s, d))), "select count(*) as raw, count(*) filter (day(trade_date) <> 13) as mapped, count(*) filter (day(trade_date) = 13) as skipped from bars"),
    "l01_pool_members": (lambda s, d: A.pool_members(D.stocks(s, d), D.stocks(s, d).filter("is_st"), S.screened(s, d).select("stock_code").distinct()), "select stock_code, pool from (select stock_code, 'active' as pool from stocks union select stock_code, 'static' from stocks where is_st union select stock_code, 'candidates' from screened) where stock_code in (select stock_code from stocks where status = 'active')"),
    "l02_latest_candidates": (lambda s, d: A.latest_candidates(S.screened(s, d)), "select rule, stock_code, max(trade_date) as trade_date, arg_max(score, trade_date) as score from screened group by 1, 2"),
    "l03_stock_profile": (lambda s, d: A.stock_profile(D.stocks(s, d), D.members(s, d)), "select stock_code, industry, coalesce(c, '') as concepts, status = 'active' and not is_st as eligible from stocks left join (select stock_code, string_agg(distinct sector_code, ',' order by sector_code) as c from members group by 1) using (stock_code)"),
    "l04_sector_reference": (lambda s, d: A.sector_reference(D.stocks(s, d), D.members(s, d)), "select sector_code, count(distinct stock_code) as n, min(stock_code) as first_stock from members where stock_code in (select stock_code from stocks where status = 'active') group by 1"),
    "l04_industry_groups": (lambda s, d: A.industry_groups(D.stocks(s, d), {"west": [0, 1], "east": [2, 3]}), "select case when region_key in (0, 1) then 'west' when region_key in (2, 3) then 'east' else 'other' end as group_name, count(distinct stock_code) as n, count(distinct industry) as industries from stocks group by 1"),
    "l05_sector_dashboard": (lambda s, d: A.sector_dashboard(Q.f06(s, d), A.catalog(D.stocks(s, d), D.members(s, d))), "select *, row_number() over (partition by trade_date order by mean_change desc nulls last, sector_code) as place from (select f.sector_code, max(trade_date) as trade_date, arg_max(mean_change, trade_date) as mean_change, first(net_inflow order by trade_date desc) as net_inflow, any_value(n) as n from f6 f left join catalog c on c.name = f.sector_code and kind = 'concept' group by 1)"),
}
MORE = {"days": "select trade_date, dayofweek(trade_date) between 1 and 5 and trade_date not in (select cast(o_orderdate as date) from orders where o_orderkey % 97 = 0) as is_open from (select cast(unnest(generate_series(make_date(lo, 1, 1), make_date(hi, 12, 31), interval 1 day)) as date) as trade_date from (select min(year(o_orderdate)) as lo, max(year(o_orderdate)) as hi from orders))", "vs": "select industry, trade_date, stock_code from bars join stocks using (stock_code) union all select industry, trade_date, stock_code from bars join stocks using (stock_code) where stock_code <= '000010'", "f5": Q.F5, "member_bars": Q.ASOF}
QUERIES = {name: entry[0] for name, entry in TABLE.items()}
ORACLES = {name: with_frames(entry[1], **{**ALL, **MORE}) for name, entry in TABLE.items()}
