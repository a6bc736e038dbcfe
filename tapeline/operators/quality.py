"""Quality of data assets: coverage, gaps with reasons, staleness, readiness, audits; and pools of stocks.

Sides that are broadcast here are the stock master (a row a listed stock), calendars (a row a day) and sector names: bounded by the market, not
by the length of history.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .relational import date_universe

KEY = ["stock_code", "trade_date"]


def asset_counts(assets: dict[str, DataFrame]) -> DataFrame:
    """By day: how many stocks each asset has; one scan of each, one pivot."""
    both = reduce(DataFrame.unionByName, [df.select(*KEY, F.lit(n).alias("asset")) for n, df in assets.items()])
    return both.groupBy("trade_date").agg(*[F.countDistinct(F.when(F.col("asset") == n, F.col("stock_code"))).alias(n) for n in assets])


def active_stocks(stocks: DataFrame) -> DataFrame:
    """The stocks that assets are expected to have: those of status active."""
    return stocks.filter("status = 'active'").select("stock_code").distinct()


def coverage(assets: dict[str, DataFrame], dates: DataFrame, stocks: DataFrame, suspensions: DataFrame) -> DataFrame:
    """By asset and day of dates: expected stocks, those there, suspended, missing, and both completenesses in percent.

    Each asset is read once; all come together in one grouping by stock and day, and days are counted from that. No grid of
    stocks by days is made: what is expected is one number.
    """
    marked = [df.select(*KEY, F.lit(n).alias("_a")) for n, df in (*assets.items(), ("_off", suspensions))]
    has = lambda n: F.max(F.when(F.col("_a") == n, True)).isNotNull()
    flags = reduce(DataFrame.unionByName, marked).join(active_stocks(stocks), "stock_code", "left_semi").groupBy(*KEY).agg(*[has(n).alias(n) for n in (*assets, "_off")])
    days = flags.groupBy("trade_date").agg(*[F.struct(F.count_if(n).alias("actual"), F.count_if(~F.col(n) & F.col("_off")).alias("suspended")).alias(n) for n in assets])
    expected = active_stocks(stocks).agg(F.count("*").alias("expected"))
    one = F.array(*[F.struct(F.lit(n).alias("asset"), F.coalesce(f"{n}.actual", F.lit(0)).alias("actual"), F.coalesce(f"{n}.suspended", F.lit(0)).alias("suspended")) for n in assets])
    out = dates.select("trade_date").join(days, "trade_date", "left").select("trade_date", F.explode(one).alias("_")).select("trade_date", "_.*").crossJoin(F.broadcast(expected))  # one row
    missing = F.col("expected") - F.col("actual") - F.col("suspended")
    return out.withColumns({"missing": missing, "completeness": F.col("actual") / F.col("expected") * 100, "effective": (F.col("actual") + F.col("suspended")) / F.col("expected") * 100})


def gaps(asset: DataFrame, bars: DataFrame, dates: DataFrame, stocks: DataFrame, suspensions: DataFrame) -> DataFrame:
    """Active stocks and days that the asset lacks, with why: suspended, no market record, or missing data."""
    grid = date_universe(dates, active_stocks(stocks), asset).filter("not present").drop("present")
    df = grid.join(suspensions.select(*KEY, F.lit(True).alias("_s")).distinct(), KEY, "left").join(bars.select(*KEY, F.lit(True).alias("_b")).distinct(), KEY, "left")
    return df.select(*KEY, F.when(F.col("_s").isNotNull(), "suspended").when(F.col("_b").isNull(), "no_market_record").otherwise("missing_data").alias("reason"))


def table_stats(assets: dict[str, DataFrame]) -> DataFrame:
    """Rows, latest day, and stocks on it, of each asset."""
    out = None
    for name, df in assets.items():
        days = df.groupBy("trade_date").agg(F.count("*").alias("n"), F.countDistinct("stock_code").alias("s"))
        part = days.agg(F.lit(name).alias("asset"), F.sum("n").alias("rows"), F.max("trade_date").alias("latest"), F.max_by("s", "trade_date").alias("stocks_at_latest"))
        out = part if out is None else out.unionByName(part)
    return out


def stale_days(stats: DataFrame, calendar: DataFrame) -> DataFrame:
    """Open days after each asset's latest, up to the calendar's last."""
    return stats.join(F.broadcast(calendar.select(F.col("trade_date").alias("_d"))), F.col("_d") > F.col("latest"), "left").groupBy("asset", "latest").agg(F.count("_d").alias("stale_days"))


def asset_summary(stats: DataFrame, stale: DataFrame, coverage_: DataFrame, lags: dict[str, int]) -> DataFrame:
    """Each asset's status: empty without rows, limited without a day, stale if it is more open days behind than its own lag (0 if lags
    has none), partial if active stocks are missing on its latest day that suspensions don't explain, else ok."""
    latest = coverage_.select("asset", F.col("trade_date").alias("latest"), "missing")
    df = stats.join(stale.select("asset", "stale_days"), "asset").join(latest, ["asset", "latest"], "left")
    lag = F.coalesce(F.create_map(*[F.lit(x) for item in lags.items() for x in item])[F.col("asset")], F.lit(0)) if lags else F.lit(0)
    status = F.when(F.coalesce("rows", F.lit(0)) == 0, "empty").when(F.col("latest").isNull(), "limited").when(F.col("stale_days") > lag, "stale").when(F.col("missing") > 0, "partial").otherwise("ok")
    return df.withColumn("status", status)


def daily_health(coverage_: DataFrame) -> DataFrame:
    status = F.when((F.col("missing") == 0) & (F.col("effective") >= 99.5), "ok").when(F.col("effective") >= 98, "partial").otherwise("stale")
    names = ["bars", "basic", "flow"]
    df = coverage_.withColumn("status", status)
    return df.groupBy("trade_date").agg(*[F.max(F.when(F.col("asset") == n, F.col("status"))).alias(n) for n in names])


#: Blocks of a day's readiness. The kind, the count it is measured by (active stocks, the day's bars, or core indexes and
#: sectors), and the least share; None asks for any row. A block whose feeds must have come names them by a column `<block>_captured`.
READINESS = {
    "bars": ("core", "active", 0.95), "basic": ("core", "bars", 0.95), "flow": ("core", "bars", 0.95), "adjust": ("core", "bars", 0.95), "index": ("core", "indexes", 0.85), "factors": ("core", "bars", 0.95),
    "events": ("enhancement", None, None), "technical": ("enhancement", "bars", 0.95), "lhb": ("enhancement", None, None), "index_basic": ("enhancement", "indexes", 0.85), "sector_bars": ("enhancement", "sectors", 0.90),
    "sector_flow": ("enhancement", None, None), "sector_factors": ("enhancement", None, None), "market_stats": ("optional", None, None),
}


def readiness(counts: DataFrame) -> DataFrame:
    """By day: blocked if a core block is missing, degraded if an enhancement is, else complete; and the missing blocks, optional ones too.

    counts: trade_date, active, indexes, sectors, a number of rows for blocks of READINESS, and for those that need feeds whether they were
    captured. Blocks that counts doesn't have aren't checked. Events and lists may have no rows on a day, if their feeds were captured.
    """

    def there(name: str, base: str | None, least: float | None) -> Column:
        ok = F.lit(True) if name in ("events", "lhb") else F.coalesce(F.col(name), F.lit(0)) > 0
        if base:
            ok = F.least(F.lit(1.0), F.coalesce(F.col(name), F.lit(0)) / F.greatest(F.lit(1), F.coalesce(F.col(base), F.lit(0)))) >= least
        return ok & F.coalesce(F.col(f"{name}_captured"), F.lit(False)) if f"{name}_captured" in counts.columns else ok

    blocks = {n: (kind, there(n, base, least)) for n, (kind, base, least) in READINESS.items() if n in counts.columns or f"{n}_captured" in counts.columns}
    fails = lambda k: reduce(lambda x, y: x | y, [~ok for kind, ok in blocks.values() if kind == k], F.lit(False))
    return counts.select("trade_date", F.when(fails("core"), "blocked").when(fails("enhancement"), "degraded").otherwise("complete").alias("status"), F.concat_ws(",", *[F.when(~ok, n) for n, (_, ok) in blocks.items()]).alias("missing"))


def _size_bucket(v: Column) -> Column:
    return F.when(v.isNull(), "null").when(v < 1e4, "below_1e4").when(v < 1e5, "below_1e5").otherwise("above")


def unit_samples(flow: DataFrame, n: int = 5) -> DataFrame:
    """The newest n rows of each size of the net flow, to look at beside unit_audit's counts."""
    bucket = _size_bucket(F.abs("main_net_inflow"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("trade_date"), "stock_code"))
    return flow.withColumn("bucket", bucket).withColumn("place", place.cast("long")).filter(F.col("place") <= n).select("bucket", "place", "stock_code", "trade_date", "main_net_inflow")


def unit_audit(flow: DataFrame) -> DataFrame:
    """By size of the net flow: rows, extremes and the median size.

    Rows are counted by cells of a thousandth of the size, in order; only the values of the cells in the middle are counted by themselves, so
    no task holds a size's values. Cells in the middle, at most two a size, are broadcast.
    """
    v = F.abs("main_net_inflow")
    df = flow.select(_size_bucket(v).alias("bucket"), "main_net_inflow", v.alias("_v"), F.coalesce(F.floor(F.log(v) * 1000), F.lit(-1_000_000)).alias("_cell"))  # no log: zero, the least
    cells = df.groupBy("bucket", "_cell").agg(F.count("*").alias("n"), F.min("main_net_inflow").alias("low"), F.max("main_net_inflow").alias("high"))
    size, middle = Window.partitionBy("bucket"), lambda c: (c("n") + c("_from") > c("_lower")) & (c("_from") <= c("_upper"))
    placed = cells.withColumns({"_from": F.sum("n").over(size.orderBy("_cell")) - F.col("n"), "_all": F.sum("n").over(size)}).withColumns({"_lower": F.floor((F.col("_all") - 1) / 2), "_upper": F.floor(F.col("_all") / 2)})
    rows = df.join(F.broadcast(placed.filter(middle(F.col)).select("bucket", "_cell", F.col("_from").alias("_start"), "_lower", "_upper")), ["bucket", "_cell"])
    values = rows.groupBy("bucket", "_cell", "_start", "_lower", "_upper", "_v").agg(F.count("*").alias("n"))
    values = values.withColumn("_from", F.col("_start") + F.sum("n").over(Window.partitionBy("bucket", "_cell").orderBy("_v")) - F.col("n")).filter(middle(F.col))
    median = values.groupBy("bucket").agg((F.min("_v") * 0.5 + F.max("_v") * 0.5).alias("median_size"))
    return cells.groupBy("bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).join(median, "bucket", "left")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def minute_actual(minutes: DataFrame) -> DataFrame:
    """By day: how many stocks' sessions of 240 minutes the rows make."""
    return minutes.groupBy("trade_date").agg(F.count("*").alias("rows"), F.ceil(F.count("*") / 240).alias("sessions"))


def catalog(stocks: DataFrame, members: DataFrame) -> DataFrame:
    """Concepts and industries with how many stocks they have, none included."""
    a = members.groupBy("sector_code").agg(F.countDistinct("stock_code").alias("n")).select(F.lit("concept").alias("kind"), F.col("sector_code").alias("name"), "n")
    b = stocks.select(F.col("industry").alias("name")).distinct().join(stocks.filter("status = 'active'").select(F.col("industry").alias("name"), "stock_code"), "name", "left").groupBy("name").agg(F.count("stock_code").alias("n")).select(F.lit("industry").alias("kind"), "name", "n")
    return a.unionByName(b)


def pool_members(stocks: DataFrame, static: DataFrame, candidates: DataFrame) -> DataFrame:
    """The members of the active, the static and the candidate pool, active stocks only."""
    live = stocks.filter("status = 'active'").select("stock_code")
    pools = live.withColumn("pool", F.lit("active")).unionByName(static.select("stock_code").withColumn("pool", F.lit("static"))).unionByName(candidates.select("stock_code").withColumn("pool", F.lit("candidates")))
    return pools.distinct().join(F.broadcast(live.distinct()), "stock_code", "left_semi")


def latest_candidates(candidates: DataFrame) -> DataFrame:
    """The last day of each rule and stock, with its score."""
    return candidates.groupBy("rule", "stock_code").agg(F.max(F.struct("trade_date", "score")).alias("x")).select("rule", "stock_code", "x.trade_date", "x.score")


def stock_profile(stocks: DataFrame, members: DataFrame) -> DataFrame:
    """Each stock's concepts, industry, and whether it may be traded."""
    m = members.groupBy("stock_code").agg(F.array_join(F.array_sort(F.collect_set("sector_code")), ",").alias("concepts"))
    return stocks.join(m, "stock_code", "left").select("stock_code", "industry", F.coalesce("concepts", F.lit("")).alias("concepts"), ((F.col("status") == "active") & ~F.col("is_st")).alias("eligible"))


def sector_reference(stocks: DataFrame, members: DataFrame) -> DataFrame:
    df = members.select("sector_code", "stock_code").distinct().join(F.broadcast(stocks.filter("status = 'active'").select("stock_code")), "stock_code")
    return df.groupBy("sector_code").agg(F.count("*").alias("n"), F.min("stock_code").alias("first_stock"))


def industry_groups(stocks: DataFrame, groups: dict[str, list[int]]) -> DataFrame:
    """Regions merged to logical groups, with how many stocks each has."""
    which = F.coalesce(*[F.when(F.col("region_key").isin(v), k) for k, v in groups.items()], F.lit("other"))
    return stocks.groupBy(which.alias("group_name")).agg(F.countDistinct("stock_code").alias("n"), F.countDistinct("industry").alias("industries"))


def sector_dashboard(factors: DataFrame, catalog_: DataFrame) -> DataFrame:
    """Each sector's last day with its catalogue size and its place by mean change."""
    from pyspark.sql.window import Window

    last = factors.groupBy("sector_code").agg(F.max_by(F.struct("trade_date", "mean_change", "net_inflow"), "trade_date").alias("x")).select("sector_code", "x.*")
    df = last.join(catalog_.filter("kind = 'concept'").select(F.col("name").alias("sector_code"), "n"), "sector_code", "left")
    return df.withColumn("place", F.row_number().over(Window.partitionBy("trade_date").orderBy(F.desc_nulls_last("mean_change"), "sector_code")).cast("long"))
