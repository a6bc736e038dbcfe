"""The market frames in DuckDB's SQL, for checking operators against an independent engine."""

from __future__ import annotations

import re

FRAMES = {
    "slots": """
select *, lpad(cast(l_suppkey as varchar), 6, '0') as stock_code,
  cast(date '2020-01-06' + cast(((s - 1) // 5) * 7 + (s - 1) % 5 as integer) as date) as trade_date, cast(20 + l_suppkey % 50 as double) as base
from (select *, row_number() over (partition by l_suppkey order by ship_date) as s from (
  select l_suppkey, ship_date,
    first(line_open order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) as open_price,
    last(line_close order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) as close_price,
    max(greatest(line_open, line_close) * (1 + l_quantity / 1000)) as high_price, min(least(line_open, line_close) * (1 - l_linenumber / 200)) as low_price,
    cast(sum(l_quantity) as bigint) as volume_hand, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as amount_yuan,
    last(l_discount order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) as last_discount,
    last(l_quantity order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) as last_quantity,
    last(l_linenumber order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) as last_line,
    last(l_partkey order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) as last_part,
    cast(sum(signed) as double) as net_all, cast(sum(case when l_quantity >= 40 then signed else 0 end) as double) as net_big, cast(sum(case when l_quantity >= 48 then signed else 0 end) as double) as net_super
  from (select *, cast(l_shipdate as date) as ship_date, cast(20 + l_suppkey % 50 as double) * (1 + (l_tax - 0.04::double)) as line_open, cast(20 + l_suppkey % 50 as double) * (1 + (l_discount - 0.05::double) * 2) as line_close,
    cast(case l_returnflag when 'A' then l_extendedprice when 'R' then -l_extendedprice else 0 end as decimal(18,2)) as signed from lineitem)
  group by l_suppkey, ship_date))""",
    "bars": """
select stock_code, trade_date, open_price, high_price, low_price, close_price, pre_close_price, (close_price / pre_close_price - 1) * 100 as change_pct, volume_hand, amount_yuan
from (select *, lag(close_price) over (partition by stock_code order by trade_date) as pre_close_price from slots where (l_suppkey * 7 + s) % 41 <> 0)""",
    "adjust": "select stock_code, trade_date, 1 + 0.05::double * (year(trade_date) - 2020) as adj_factor from slots where (l_suppkey + s) % 17 <> 0",
    "flow": "select stock_code, trade_date, net_all as main_net_inflow, net_big as big_order_net_inflow, net_super as super_large_net_inflow from slots where (l_suppkey * 7 + s) % 41 <> 0 and (l_suppkey + s) % 13 <> 0",
    "basic": "select stock_code, trade_date, volume_hand / (1 + l_suppkey % 10) as turnover_rate, amount_yuan / 10000 as total_mv, case when s % 7 <> 0 then close_price / 2 end as pe from slots where (l_suppkey * 7 + s) % 41 <> 0 and (l_suppkey + s) % 19 <> 0",
    "limit_events": """
select stock_code, trade_date, event_type, case when event_type <> 'suspend' then base * 1.1::double end as limit_price, case when event_type <> 'suspend' then cast(cast(last_quantity as bigint) % 4 as integer) end as open_count,
  case when event_type <> 'suspend' then printf('%02d:%02d:00', 9 + last_line % 6, last_line * 7) end as first_time
from (select *, case when (l_suppkey * 7 + s) % 41 = 0 then 'suspend' when last_discount >= 0.095::double then 'limit_up' when last_discount >= 0.085::double then 'limit_break' when last_discount <= 0.005::double then 'limit_down' end as event_type from slots) where event_type is not null""",
    "stocks": """
select p.stock_code, s_name as stock_name, case when s_suppkey % 2 = 0 then 'SH' else 'SZ' end as exchange, case when s_suppkey % 37 = 5 then 'suspended' else 'active' end as status, s_suppkey % 29 = 3 as is_st, n_name as industry, n_regionkey as region_key, list_date
from (select *, lpad(cast(s_suppkey as varchar), 6, '0') as stock_code from supplier) p left join nation on s_nationkey = n_nationkey left join (select stock_code, min(trade_date) as list_date from slots group by 1) f on f.stock_code = p.stock_code""",
    "calendar": """
select idx, d(idx) as trade_date, case when idx > 1 then d(idx - 1) end as previous_trade_date, d(idx + 1) as next_trade_date from (select unnest(generate_series(1, (select max(s) from slots))) as idx)""",
    "members": "select p_brand as sector_code, stock_code, min(trade_date) as start_date, case when count(*) % 3 <> 0 then max(trade_date) end as end_date from slots join part on last_part = p_partkey group by 1, 2",
    "minutes": """
select lpad(cast(user_id % 10 as varchar), 6, '0') as stock_code, cast(ts as date) as trade_date, ts as bar_time, event_id, 10 + value / 100 as price, v as volume_hand, (10 + value / 100) * v * 100 as amount_yuan
from (select *, case when k % 10 <> 0 then k else 0 end as v from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events))""",
    "quotes": """
select stock_code, round_time, quote_time, last_price, pre_close_price, (last_price / pre_close_price - 1) * 100 as change_pct, open_price, high_price, low_price, n * 100 as volume_share, last_price * n * 100 as amount_yuan, pre_close_price * 1.1::double as limit_up, pre_close_price * 0.9::double as limit_down
from (select *, lag(last_price) over (partition by stock_code order by round_time) as pre_close_price from (
  select stock_code, round_time, max(ts) as quote_time, 10 + last(value order by ts, event_id) / 100 as last_price, 10 + first(value order by ts, event_id) / 100 as open_price, 10 + max(value) / 100 as high_price, 10 + min(value) / 100 as low_price, count(*) as n
  from (select *, lpad(cast(user_id % 100 as varchar), 6, '0') as stock_code, date_trunc('hour', ts) as round_time from events) group by 1, 2)) where pre_close_price is not null""",
}


def _dates(sql: str) -> str:
    """d(x): the x-th weekday of the dense calendar."""
    return re.sub(r"\bd\(([^()]*)\)", r"cast(date '2020-01-06' + cast((((\1) - 1) // 5) * 7 + ((\1) - 1) % 5 as integer) as date)", sql)


def with_frames(body: str, **more: str) -> str:
    """body with the frames that it names, and those that they name, before it; more adds frames of its own, in order."""
    found: dict[str, str] = {}

    def need(sql: str) -> None:
        for name, frame in {**FRAMES, **more}.items():
            if re.search(rf"\b{name}\b", sql) and name not in found:
                found[name] = ""  # guards against itself
                need(frame)
                del found[name]
                found[name] = frame

    need(body)
    return "with " + ",\n".join(f"{k} as materialized ({_dates(v).strip()})" for k, v in found.items()) + "\n" + body.strip() if found else body.strip()
