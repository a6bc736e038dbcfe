"""Reads, joins, orders and set operations over canonical tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def filter_range(df: DataFrame, start: str, end: str, codes: list[str] | None = None) -> DataFrame:
    df = df.filter(F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return df.filter(F.col("stock_code").isin(codes)) if codes else df


def restrict(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose key columns are among keys' rows."""
    return df.join(keys.distinct(), keys.columns, "left_semi")


def search(stocks: DataFrame, keyword: str, limit: int = 20) -> DataFrame:
    """Stocks whose code or name contains the keyword, whatever its case; active ones first."""
    hit = F.contains(F.lower("stock_code"), F.lit(keyword.lower())) | F.contains(F.lower("stock_name"), F.lit(keyword.lower()))
    return stocks.filter(hit).orderBy(F.when(F.col("status") == "active", 0).otherwise(1), "stock_code").limit(limit)


def search_candidates(stocks: DataFrame, members: DataFrame, keyword: str, limit: int = 20) -> DataFrame:
    """As search, by rank: code begins with the keyword, name does, or neither; is_member says whether the pool has it."""
    k = keyword.lower()
    rank = F.when(F.lower("stock_code").startswith(k), 0).when(F.lower("stock_name").startswith(k), 1).otherwise(2)
    hit = F.contains(F.lower("stock_code"), F.lit(k)) | F.contains(F.lower("stock_name"), F.lit(k))
    m = members.select("stock_code", F.lit(True).alias("_m")).distinct()
    df = stocks.filter(hit).join(m, "stock_code", "left").withColumn("rank", rank.cast("long"))
    return df.orderBy("rank", "stock_code").limit(limit).select("stock_code", "stock_name", "rank", F.col("_m").isNotNull().alias("is_member"))


def page(df: DataFrame, order: list[Column | str], number: int, size: int) -> DataFrame:
    """The number-th page (from 1) with the total of rows on each."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(total)  # one row


def json_path(df: DataFrame, column: str, path: str, out: str) -> DataFrame:
    return df.withColumn(out, F.get_json_object(column, path))


def has_any(column: str, values: list[str]) -> Column:
    return F.arrays_overlap(column, F.array(*map(F.lit, values)))


def staleness(df: DataFrame, by: str, target: str) -> DataFrame:
    """The latest day of each `by`, its age in days at the target, and whether it is behind."""
    t = F.lit(target).cast("date")
    return df.groupBy(by).agg(F.max("trade_date").alias("latest")).withColumns({"age_days": F.datediff(t, "latest").cast("long"), "is_stale": F.col("latest") < t})


def resolve_sources(frames: list[tuple[str, DataFrame]], keys: list[str]) -> DataFrame:
    """Each key's row from the first source that has it; attempted lists the sources that do."""
    both = reduce(DataFrame.unionByName, [df.withColumns({"source": F.lit(name), "_p": F.lit(i)}) for i, (name, df) in enumerate(frames)])
    w = Window.partitionBy(*keys)
    df = both.withColumns({"_n": F.row_number().over(w.orderBy("_p")), "attempted": F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("_p", "source")).over(w)), lambda x: x["source"]), ",")})
    return df.filter("_n = 1").drop("_n", "_p")


def daily_fact(bars: DataFrame, basic: DataFrame, flow: DataFrame) -> DataFrame:
    """Bars with what basic and flow know, flags of which do, the volume against the five days before, and the net flow against the amount."""
    keys = ["stock_code", "trade_date"]
    w = Window.partitionBy("stock_code").orderBy("trade_date").rowsBetween(-5, -1)
    mean = F.avg("volume_hand").over(w)
    df = bars.withColumn("volume_ratio", F.round(F.col("volume_hand") / F.when(mean != 0, mean), 6))
    df = df.join(basic.select(*keys, "turnover_rate", F.lit(True).alias("_b")), keys, "left").join(flow.select(*keys, "main_net_inflow", F.lit(True).alias("_f")), keys, "left")
    return df.select(*keys, "close_price", "turnover_rate", "main_net_inflow", "volume_ratio", F.col("_b").isNotNull().alias("has_basic"), F.col("_f").isNotNull().alias("has_flow"), (F.col("main_net_inflow") / F.greatest("amount_yuan", F.lit(1.0)) * 100).alias("net_ratio"))


def last_n_agg(bars: DataFrame, n: int) -> DataFrame:
    """The mean close and rows of each stock's last n bars, without looking at each stock by itself."""
    w = Window.partitionBy("stock_code").orderBy(F.desc("trade_date"))
    return bars.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).groupBy("stock_code").agg(F.round(F.avg("close_price"), 6).alias("mean_close"), F.count("*").alias("rows"))


def date_universe(dates: DataFrame, stocks: DataFrame, facts: DataFrame) -> DataFrame:
    """Every day with every stock, and whether facts have it. Days are sent to the stocks, which are dealt before that, so that the grid isn't."""
    grid_ = stocks.select("stock_code").repartition("stock_code").crossJoin(F.broadcast(dates.select("trade_date")))
    return grid_.join(facts.select("stock_code", "trade_date", F.lit(True).alias("_f")).distinct(), ["stock_code", "trade_date"], "left").select("stock_code", "trade_date", F.col("_f").isNotNull().alias("present"))


def forward_path(signals: DataFrame, bars: DataFrame, calendar: DataFrame, h: int) -> DataFrame:
    """The bars of the h open days after each signal."""
    cal = F.broadcast(calendar.select("trade_date", "idx"))
    s = signals.select("stock_code", F.col("trade_date").alias("signal_date")).join(cal.withColumnRenamed("trade_date", "signal_date"), "signal_date").withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(h)))).withColumn("idx", F.col("idx") + F.col("day"))
    return s.join(bars.join(cal, "trade_date").select("stock_code", "idx", "trade_date", "close_price"), ["stock_code", "idx"]).select("stock_code", "signal_date", F.col("day").cast("long").alias("day"), "trade_date", "close_price")


def resolve_leader(flow: DataFrame, members: DataFrame) -> DataFrame:
    """The code of each sector's named leader within that sector, the least of several; null where no member has the name."""
    m = members.select("sector_code", F.col("stock_name").alias("lead_stock"), F.col("stock_code").alias("leader_code"))
    return flow.join(m.groupBy("sector_code", "lead_stock").agg(F.min("leader_code").alias("leader_code")), ["sector_code", "lead_stock"], "left")


def latest_state(candidates: DataFrame, states: DataFrame, now: str, max_age: int, time: str = "quote_time", columns: tuple[str, ...] = ("last_price",), fresh: str = "fresh") -> DataFrame:
    """Each candidate with `columns` of its latest state not after now, and whether that is fresh enough. Of states of one time
    the greatest counts."""
    t = F.lit(now).cast("timestamp")
    last = states.filter(F.col(time) <= t).groupBy("stock_code").agg(F.max(F.struct(time, *columns)).alias("_s")).select("stock_code", "_s.*")
    return candidates.join(last, "stock_code", "left").withColumn(fresh, F.coalesce(F.unix_timestamp(t) - F.unix_timestamp(time) <= max_age, F.lit(False)))


def trend_history(df: DataFrame, columns: list[str], n: int) -> DataFrame:
    """The named columns of the newest n days, in order; the scan reads no others."""
    return df.select("trade_date", *columns).orderBy(F.desc("trade_date")).limit(n).orderBy("trade_date")


def stock_overview(stocks: DataFrame, bars: DataFrame, basic: DataFrame, members: DataFrame) -> DataFrame:
    """Each stock of the master with its newest bar, newest valuation and the number of its sectors; null where it has none."""
    last = lambda df, name, *columns: df.groupBy("stock_code").agg(F.max_by(F.struct(F.col("trade_date").alias(f"{name}_date"), *columns), "trade_date").alias("_s")).select("stock_code", "_s.*")
    sectors = members.groupBy("stock_code").agg(F.countDistinct("sector_code").alias("sectors"))
    df = stocks.select("stock_code", "stock_name", "status")
    for part in (last(bars, "bar", "close_price", "change_pct"), last(basic, "basic", "turnover_rate", "pe"), sectors):
        df = df.join(part, "stock_code", "left")
    return df.withColumn("sectors", F.coalesce("sectors", F.lit(0).cast("long")))


def stock_series(bars: DataFrame, factors: DataFrame, n: int, averages: tuple[str, ...] = ("ma5", "ma20", "ma60")) -> DataFrame:
    """Each stock's newest n bars with their moving averages, null where a day has no factors."""
    w = Window.partitionBy("stock_code").orderBy(F.desc("trade_date"))
    recent = bars.select("stock_code", "trade_date", "close_price").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")
    return recent.join(factors.select("stock_code", "trade_date", *averages), ["stock_code", "trade_date"], "left")


def stock_session(minutes: DataFrame, bars: DataFrame) -> DataFrame:
    """The minutes of each stock's newest session only, with the close before it as the reference price (null without a bar that day)."""
    newest = minutes.groupBy("stock_code").agg(F.max("trade_date").alias("trade_date"))
    reference = bars.select("stock_code", "trade_date", F.col("pre_close_price").alias("reference_price"))
    return minutes.join(newest, ["stock_code", "trade_date"], "left_semi").join(reference, ["stock_code", "trade_date"], "left")


def stock_events(events: DataFrame, as_of: str, days: int, n: int) -> DataFrame:
    """Each stock's newest n events of the last `days` days."""
    w = Window.partitionBy("stock_code").orderBy(F.desc("trade_date"), "event_type")
    recent = events.filter(F.col("trade_date").between(F.date_sub(F.lit(as_of).cast("date"), days), F.lit(as_of).cast("date")))
    return recent.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def last_n_dates(calendar: DataFrame, n: int) -> DataFrame:
    return calendar.select("trade_date").orderBy(F.desc("trade_date")).limit(n).orderBy("trade_date")


def top_k(df: DataFrame, metric: str, k: int, tie: str = "stock_code") -> DataFrame:
    return df.orderBy(F.desc_nulls_last(metric), tie).limit(k)


def top_k_per(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).filter(F.col("place") <= k)


def argmax_per(df: DataFrame, by: str, value: str, key: str) -> DataFrame:
    """Each group's greatest and least row, ties to the smaller key."""
    w = Window.partitionBy(by)
    df = df.filter(F.col(value).isNotNull()).withColumns({"_a": F.row_number().over(w.orderBy(F.desc(value), key)), "_b": F.row_number().over(w.orderBy(value, key))})
    return df.groupBy(by).agg(F.max(F.when(F.col("_a") == 1, F.col(key))).alias("leader"), F.max(F.when(F.col("_b") == 1, F.col(key))).alias("laggard"))


def bucket_counts(df: DataFrame, by: str, value: str, edges: list[float]) -> DataFrame:
    """How many values lie below the first edge, between each two, and from the last on."""
    c = F.col(value)
    parts = [F.count_if(c < edges[0]).alias("b0"), *[F.count_if((c >= a) & (c < b)).alias(f"b{i}") for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False), 1)], F.count_if(c >= edges[-1]).alias(f"b{len(edges)}")]
    return df.groupBy(by).agg(*parts)


def union_distinct(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames).distinct()


def overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many distinct keys of a are in b."""
    return a.select(keys).distinct().join(b.select(keys).distinct(), keys, "left_semi").agg(F.count("*").alias("shared"))
