"""Normalisers: raw vendor feeds (strings) to typed canonical rows. Rows with a bad key or date, or outside the universe, go.

Sides that are broadcast here are the stock master (a row a listed stock), calendars (a row a day) and sector names: bounded by the market, not
by the length of history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def number(c: str | Column) -> Column:
    """A number from text; blank and unreadable text is null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(c).try_cast("double")


def whole(c: str | Column) -> Column:
    """A whole number from text, fractions cut off."""
    return number(c).cast("long")


def text(c: str | Column) -> Column:
    """Text without NUL and outer blanks; blank is null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.trim(F.translate(c, "\0", "")), F.lit(""))


def first_text(*columns: str) -> Column:
    return F.coalesce(*map(text, columns))


def symbol(c: str | Column) -> Column:
    """600519.SH to 600519."""
    return F.substring_index(text(c), ".", 1)


def vendor_symbol(c: str) -> Column:
    """600519 to 600519.SH, by its first digit."""
    code = F.col(c)
    return F.concat(code, F.when(code.startswith("6"), ".SH").when(code.startswith("4") | code.startswith("8"), ".BJ").otherwise(".SZ"))


def day(c: str) -> Column:
    """A date as yyyy-MM-dd, yyyy/MM/dd or yyyyMMdd."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(p)) for p in ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd")]).cast("date")


def moment(c: str, zone: str = "Asia/Shanghai") -> Column:
    """An instant (UTC) from local time without a zone."""
    return F.to_utc_timestamp(F.try_to_timestamp(F.trim(c)), zone)


def field(raw: DataFrame, *names: str) -> Column:
    """The first of the named columns that has text; columns that the feed lacks count as blank."""
    return F.coalesce(*[text(n) for n in names if n in raw.columns], F.lit(None).cast("string"))


def numbers(raw: DataFrame, scale: float = 1, **columns: str) -> list[Column]:
    """Canonical name = column of the feed, as numbers times scale."""
    return [(number(field(raw, c)) * scale if scale != 1 else number(field(raw, c))).alias(name) for name, c in columns.items()]


def clock(c: Column) -> Column:
    """A time of day as HH:mm:ss from HH:mm:ss, HH:mm or digits (93005 is 09:30:05); else null."""
    digits = F.lpad(F.regexp_extract(c, r"^(\d{1,6})(\.\d*)?$", 1), 6, "0")
    spaced = F.concat_ws(":", F.substring(digits, 1, 2), F.substring(digits, 3, 2), F.substring(digits, 5, 2))
    out = F.when(c.rlike(r"^\d{1,6}(\.\d*)?$"), spaced).when(c.rlike(r"^\d\d:\d\d$"), F.concat(c, F.lit(":00"))).otherwise(c)
    return F.when(out.rlike(r"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d$"), out)


def derive_trade_date(df: DataFrame, zone: str = "Asia/Shanghai") -> DataFrame:
    """trade_date: the local date of bar_time, which is UTC."""
    return df.withColumn("trade_date", F.to_date(F.from_utc_timestamp("bar_time", zone)))


def keyed(raw: DataFrame, universe: DataFrame | None = None, start: str | None = None, end: str | None = None, code: str = "ts_code", date: str = "trade_date") -> DataFrame:
    """raw with stock_code and trade_date; rows without either, out of the window or of the universe go."""
    df = raw.withColumns({"stock_code": symbol(code), "_day": day(date)}).drop(date).withColumnRenamed("_day", "trade_date")
    df = df.filter(F.col("stock_code").isNotNull() & F.col("trade_date").isNotNull())
    if start:
        df = df.filter(F.col("trade_date").between(start, end))
    return df.join(universe.select("stock_code"), "stock_code", "left_semi") if universe is not None else df


def normalize_daily(raw: DataFrame, universe: DataFrame | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars: amount from thousands to yuan, volume in hands and shares."""
    df = keyed(raw, universe, start, end)
    prices = numbers(df, open_price="open", high_price="high", low_price="low", close_price="close", pre_close_price="pre_close", change_amount="change", change_pct="pct_chg")
    return df.select("stock_code", "trade_date", *prices, whole("vol").alias("volume_hand"), (number("vol") * 100).cast("long").alias("volume_share"), (number("amount") * 1000).alias("amount_yuan"))


#: Fields of the daily valuation feed.
BASIC = ("turnover_rate", "turnover_rate_f", "volume_ratio", "pe", "pe_ttm", "pb", "ps", "ps_ttm", "dv_ratio", "dv_ttm", "total_share", "float_share", "free_share", "total_mv", "circ_mv")
#: Order sizes of the money-flow feed: code, name, and name of the net.
SIZES = (("sm", "small", "small_net_inflow"), ("md", "medium", "medium_net_inflow"), ("lg", "large", "big_order_net_inflow"), ("elg", "super_large", "super_large_net_inflow"))


def normalize_daily_basic(raw: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Valuation and liquidity, in the vendor's units."""
    df = keyed(raw, universe)
    return df.select("stock_code", "trade_date", *numbers(df, **{c: c for c in BASIC}))


def normalize_moneyflow(raw: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Flows from ten thousands to yuan: the main one, and both sides and the net of each order size; a net is null if either side is."""
    df = keyed(raw, universe)
    main = numbers(df, 10000, main_net_inflow="net_mf_amount")
    sides = numbers(df, 10000, **{f"{name}_{side}_amount": f"{side}_{k}_amount" for k, name, _ in SIZES for side in ("buy", "sell")})
    df = df.select("stock_code", "trade_date", *main, *sides)
    return df.select("*", *[(F.col(f"{name}_buy_amount") - F.col(f"{name}_sell_amount")).alias(net) for _, name, net in SIZES])


def normalize_adj_factor(raw: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    return keyed(raw, universe).select("stock_code", "trade_date", number("adj_factor").alias("adj_factor")).filter("adj_factor is not null")


def normalize_limit_events(raw: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Flag U, D, Z from the first of two fields; no flag with an up_stat means U; open_count from the first of two fields too."""
    df = keyed(raw, universe)
    flag = F.coalesce(F.upper(field(df, "limit", "limit_type")), F.when(field(df, "up_stat").isNotNull(), "U"))
    kind = F.when(flag == "U", "limit_up").when(flag == "D", "limit_down").when(flag == "Z", "limit_break").otherwise("limit_event")
    times = [clock(field(df, c)).alias(c) for c in ("first_time", "last_time")]
    return df.select("stock_code", "trade_date", kind.alias("event_type"), whole(field(df, "open_times", "open_count")).alias("open_count"), *numbers(df, close_price="close", limit_price="limit_price", turnover_amount="amount"), *times)


def normalize_suspensions(raw: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Rows of the same table as limit events, which only say that the stock is suspended."""
    none = [F.lit(None).cast(t).alias(c) for c, t in (("open_count", "long"), ("close_price", "double"), ("limit_price", "double"), ("turnover_amount", "double"), ("first_time", "string"), ("last_time", "string"))]
    return keyed(raw, universe).select("stock_code", "trade_date", F.lit("suspend").alias("event_type"), *none)


def normalize_index_daily(raw: DataFrame, codes: list[str] | None = None) -> DataFrame:
    values = numbers(raw, open_price="open", high_price="high", low_price="low", close_price="close", change_pct="pct_chg", volume="vol")
    df = raw.select(text("ts_code").alias("index_code"), day("trade_date").alias("trade_date"), *values, *numbers(raw, 1000, amount_yuan="amount")).filter("index_code is not null and trade_date is not null")
    return df.filter(F.col("index_code").isin(codes)) if codes else df


def normalize_units_kept(raw: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Index values and market statistics: keys and numbers, in the vendor's units."""
    return raw.select(text(key).alias(key), day("trade_date").alias("trade_date"), *[number(c).alias(c) for c in columns]).filter(F.col(key).isNotNull() & F.col("trade_date").isNotNull())


def normalize_sector_bar(raw: DataFrame, sector_map: DataFrame) -> DataFrame:
    """A board's raw code by the map, or ths_ and the code where the map lacks it."""
    m = F.broadcast(sector_map.select(F.col("raw_code").alias("_raw"), "sector_code"))
    df = raw.withColumn("_code", text("ts_code")).join(m, F.col("_code") == F.col("_raw"), "left")
    values = numbers(raw, open_price="open", high_price="high", low_price="low", close_price="close", pre_close_price="pre_close", change_amount="change", volume="vol", turnover_rate="turnover_rate")
    return df.select(F.coalesce("sector_code", F.concat(F.lit("ths_"), "_code")).alias("sector_code"), day("trade_date").alias("trade_date"), *values, number(field(raw, "pct_change", "pct_chg")).alias("change_pct"), *numbers(raw, 1000, amount_yuan="amount")).filter("sector_code is not null and trade_date is not null")


def normalize_sector_flow(raw: DataFrame, sector_map: DataFrame) -> DataFrame:
    m = F.broadcast(sector_map.select(F.col("raw_code").alias("_raw"), "sector_code"))
    df = raw.withColumn("_code", first_text("ts_code", "name")).join(m, F.col("_code") == F.col("_raw"), "left")
    return df.select(F.coalesce("sector_code", "_code").alias("sector_code"), day("trade_date").alias("trade_date"), (number("net_amount") * 10000).alias("main_net_inflow"), text("lead_stock").alias("lead_stock")).filter("sector_code is not null and trade_date is not null")


def normalize_lhb(raw: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Dragon-tiger list rows, in yuan; a reason by default."""
    df = keyed(raw, universe)
    money = numbers(df, 10000, turnover_amount="amount", net_buy_amount="net_amount", buy_amount="l_buy", sell_amount="l_sell")
    return df.select("stock_code", field(df, "name").alias("stock_name"), "trade_date", F.coalesce(field(df, "reason"), F.lit("unspecified")).alias("reason"), *numbers(df, close_price="close"), number(field(df, "pct_change", "pct_chg")).alias("change_pct"), *money)


def normalize_technical(raw: DataFrame, keys: tuple[str, ...] = ("ts_code", "trade_date")) -> DataFrame:
    """Every other column that isn't null, as a map of numbers."""
    df = keyed(raw)
    names = [c for c in raw.columns if c not in keys]
    return df.select("stock_code", "trade_date", F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n), number(n))]), lambda _, v: v.isNotNull()).alias("factors"))


def normalize_north_flow(raw: DataFrame, dates: DataFrame) -> DataFrame:
    df = raw.select(day("trade_date").alias("trade_date"), *[number(c).alias(c) for c in ("hgt", "sgt", "north_money")], F.lit("vendor").alias("value_unit"))
    return df.join(F.broadcast(dates.select("trade_date")), "trade_date", "left_semi")


#: Further topics: key columns and number columns of each.
TOPICS = {"income": (["ts_code", "end_date"], ["revenue", "n_income"]), "dividend": (["ts_code", "end_date"], ["cash_div"]), "margin": (["trade_date", "exchange_id"], ["rzye", "rqye"]), "holders": (["ts_code", "end_date"], ["holder_num"])}


def normalize_topic(raw: DataFrame, topic: str, newest: str) -> DataFrame:
    """A topic's rows, keyed: of equal keys the one with the greatest `newest` (when the feed sent it), ties by their numbers."""
    keys, values = TOPICS[topic]
    df = raw.select(*[(day(k) if k.endswith("date") else symbol(k)).alias(k) for k in keys], *[number(n).alias(n) for n in values], F.col(newest).alias("_newest"))
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("_newest"), *[F.desc_nulls_last(n) for n in values])
    return df.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "_newest")


def normalize_stock_master(raw: DataFrame) -> DataFrame:
    """Status by flag, name and exchange; only mainland codes (0, 3, 6 and those of Beijing, which are excluded)."""
    code, name = symbol("ts_code"), F.coalesce(text("name"), F.lit(""))
    beijing = code.startswith("4") | code.startswith("8") | code.startswith("920")
    flag = F.upper(text("list_status"))
    status = F.when(beijing, "excluded").when((flag == "D") | name.endswith("退") | name.startswith("退市"), "delisted").when(flag == "P", "suspended").otherwise("active")
    df = raw.select(code.alias("stock_code"), text("name").alias("stock_name"), status.alias("status"), F.ltrim(F.upper(name)).rlike(r"^\*?ST").alias("is_st"), day("list_date").alias("list_date"), beijing.alias("_b"))
    return df.filter(F.col("_b") | F.substring("stock_code", 1, 1).isin("0", "3", "6")).drop("_b")


def merge_master(new: DataFrame, old: DataFrame, top: str = "exchange") -> DataFrame:
    """Columns of the new master over the old; an excluded or delisted status stays unless the new row's source is the top one."""
    n, o = new.alias("n"), old.alias("o")
    df = n.join(o, F.col("n.stock_code") == F.col("o.stock_code"), "full")
    held = F.col("o.status").isin("excluded", "delisted") & ~F.coalesce(F.col("n.source") == top, F.lit(False))
    return df.select(F.coalesce("n.stock_code", "o.stock_code").alias("stock_code"), F.coalesce("n.stock_name", "o.stock_name").alias("stock_name"), F.when(held, F.col("o.status")).otherwise(F.coalesce("n.status", "o.status")).alias("status"))


def normalize_quotes(raw: DataFrame) -> DataFrame:
    """Change and its percent where the feed lacks them; prices of 0 or less are null."""
    price = lambda c: F.when(number(c) > 0, number(c))
    last, pre = price("last_price"), price("pre_close")
    return raw.select(symbol("ts_code").alias("stock_code"), last.alias("last_price"), pre.alias("pre_close_price"), F.coalesce(number("change"), last - pre).alias("change_amount"), F.coalesce(number("pct"), (last / pre - 1) * 100).alias("change_pct")).filter("stock_code is not null")


def normalize_depth(raw: DataFrame) -> DataFrame:
    """Five levels from JSON arrays of [price, volume]; empty ones go."""
    side = lambda c: F.filter(F.transform(F.slice(F.from_json(c, "array<array<double>>"), 1, 5), lambda x, i: F.struct((i + 1).alias("level"), x[0].alias("price"), x[1].cast("long").alias("volume"))), lambda x: (x["price"] > 0) & (x["volume"] > 0))
    return raw.select("stock_code", "depth_time", side("bids").alias("bids"), side("asks").alias("asks"))


def build_calendar(span: DataFrame, holidays: DataFrame) -> DataFrame:
    """Each day of the years from first_year to last_year of span's one row: open on weekdays that aren't holidays (day), with the open
    days around it (for open days only). One row a day."""
    year = lambda c, m, d: F.make_date(F.col(c), F.lit(m), F.lit(d))
    days = span.select(F.explode(F.sequence(year("first_year", 1, 1), year("last_year", 12, 31))).alias("trade_date"))
    off = F.broadcast(holidays.select(F.col("day").alias("trade_date"), F.lit(True).alias("_off")).distinct())  # days, not rows
    df = days.join(off, "trade_date", "left").select("trade_date", (F.col("_off").isNull() & (F.dayofweek("trade_date") > 1) & (F.dayofweek("trade_date") < 7)).alias("is_open"))
    w = Window.orderBy("trade_date")  # one row a day
    opened = df.filter("is_open").select("trade_date", F.lag("trade_date").over(w).alias("previous_trade_date"), F.lead("trade_date").over(w).alias("next_trade_date"))
    return df.join(opened, "trade_date", "left")


def mapping_report(raw: DataFrame, mapped: DataFrame) -> DataFrame:
    """One row: rows read, rows kept, rows skipped."""
    n = mapped.agg(F.count("*").alias("mapped"))
    return raw.agg(F.count("*").alias("raw")).crossJoin(n).withColumn("skipped", F.col("raw") - F.col("mapped"))  # one row each
