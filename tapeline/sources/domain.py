"""Market frames made from the general tables: bars, flows, events, membership and so on.

They stand for canonical market tables where only the general test tables are at hand. Each takes (spark, folder of tables).
"""

from __future__ import annotations

import tempfile

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Frames of stock days that this session keeps, by application and folder.
_KEPT: dict[tuple[str, str], DataFrame] = {}
FIRST_DAY = "2020-01-06"
#: Lines that a task of `slots` takes: few enough to be sorted in memory, whatever the table's size.
LINES_A_TASK = 1_200_000
#: Up to so many parts, Spark writes each line to its part's file at once (spark.shuffle.sort.bypassMergeThreshold); with more, a map task
#: holds all its lines in memory until it ends.
STREAMED_PARTS = 200
#: Rows of a batch of the kept frame. At 10000, Spark's default, the batches that a task has read stayed on the heap until it ended, a copy for
#: each scan, beside the memory that Spark counts (measured; it wasn't looked into what holds them).
BATCH_ROWS = 1000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def nth_weekday(s: Column) -> Column:
    """The s-th weekday from the first Monday on, counting from 1."""
    return F.date_add(F.lit(FIRST_DAY).cast("date"), (F.floor((s - 1) / 5) * 7 + (s - 1) % 5).cast("int"))


def _code(key: str) -> Column:
    return F.lpad(F.col(key).cast("string"), 6, "0")


def slots(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each stock and day of its own calendar, days without a bar included.

    All frames of stock days come from it, so it is worked out once a session and folder and kept on the executors, in memory
    or on their disks, dealt and ordered by stock: windows by stock need no further exchange, nor do joins by stock and day, as the
    session lets sides that are dealt by some of a join's keys meet. What an executor loses is worked out again. `release` lets it go.
    """
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.inMemoryColumnarStorage.batchSize", str(BATCH_ROWS))
    key = (spark.sparkContext.applicationId, folder)
    if key not in _KEPT:
        _KEPT[key] = _slots(spark, folder).persist(StorageLevel.MEMORY_AND_DISK)
    return _KEPT[key]


def once(df: DataFrame) -> DataFrame:
    """df, worked out now into the shared checkpoint folder and read from there: for small frames that a query names several times.

    The folder is the one the cluster names in spark.checkpoint.dir; only a local session without one gets its own.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Lets go of the frames that this session keeps."""
    for key in [k for k in _KEPT if k[0] == spark.sparkContext.applicationId]:
        _KEPT.pop(key).unpersist()


def _slots(spark: SparkSession, folder: str) -> DataFrame:
    """Lines go through one exchange, by stock. Hardly two of them share a day, so they are not put together before it; first and last
    lines of a day are one struct each, as wide as a line."""
    lines = table(spark, folder, "lineitem")
    n = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), STREAMED_PARTS), -(-lines.count() // LINES_A_TASK), 1)
    line = lines.select(_code("l_suppkey").alias("stock_code"), "l_suppkey", F.col("l_shipdate").cast("date").alias("ship_date"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag").repartition(n, "stock_code")
    base = (F.lit(20) + F.col("l_suppkey") % 50).cast("double")
    line = line.withColumns({"line_open": base * (1 + (F.col("l_tax") - 0.04)), "line_close": base * (1 + (F.col("l_discount") - 0.05) * 2)})
    order = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    high = F.greatest("line_open", "line_close") * (1 + F.col("l_quantity") / 1000)
    low = F.least("line_open", "line_close") * (1 - F.col("l_linenumber") / 200)
    big = F.when(F.col("l_returnflag") == "A", F.col("l_extendedprice")).when(F.col("l_returnflag") == "R", -F.col("l_extendedprice")).otherwise(0.0).cast("decimal(18,2)")
    days = line.groupBy("stock_code", "l_suppkey", "ship_date").agg(
        F.min(F.struct(*order, "line_open")).alias("_first"), F.max(F.struct(*order, "line_close", "l_discount")).alias("_last"), F.max(high).alias("high_price"), F.min(low).alias("low_price"),
        F.sum("l_quantity").cast("long").alias("volume_hand"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("amount_yuan"),
        F.sum(big).cast("double").alias("net_all"), F.sum(F.when(F.col("l_quantity") >= 40, big).otherwise(0)).cast("double").alias("net_big"), F.sum(F.when(F.col("l_quantity") >= 48, big).otherwise(0)).cast("double").alias("net_super"),
    )
    s = F.row_number().over(Window.partitionBy("stock_code", "l_suppkey").orderBy("ship_date"))
    days = days.select(
        "l_suppkey", "ship_date", F.col("_first.line_open").alias("open_price"), F.col("_last.line_close").alias("close_price"), "high_price", "low_price", "volume_hand", "amount_yuan",
        F.col("_last.l_discount").alias("last_discount"), F.col("_last.l_quantity").alias("last_quantity"), F.col("_last.l_linenumber").alias("last_line"), F.col("_last.l_partkey").alias("last_part"),
        "net_all", "net_big", "net_super", s.alias("s"), "stock_code",
    )
    return days.withColumns({"trade_date": nth_weekday(F.col("s")), "base": base}).sortWithinPartitions("stock_code", "trade_date")


def _traded() -> Column:
    return (F.col("l_suppkey") * 7 + F.col("s")) % 41 != 0


def bars(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars of stocks on a dense weekday calendar; about one day in forty has none."""
    df = slots(spark, folder).filter(_traded())
    w = Window.partitionBy("stock_code").orderBy("trade_date")
    df = df.withColumn("pre_close_price", F.lag("close_price").over(w))
    return df.select("stock_code", "trade_date", "open_price", "high_price", "low_price", "close_price", "pre_close_price", ((F.col("close_price") / F.col("pre_close_price") - 1) * 100).alias("change_pct"), "volume_hand", "amount_yuan")


def adjust(spark: SparkSession, folder: str) -> DataFrame:
    """Adjustment factors that grow by year; about one in seventeen is missing."""
    df = slots(spark, folder).filter((F.col("l_suppkey") + F.col("s")) % 17 != 0)
    return df.select("stock_code", "trade_date", (1 + 0.05 * (F.year("trade_date") - 2020)).alias("adj_factor"))


def flow(spark: SparkSession, folder: str) -> DataFrame:
    """Net money flows by order size, in yuan; absent on some days."""
    df = slots(spark, folder).filter(_traded() & ((F.col("l_suppkey") + F.col("s")) % 13 != 0))
    return df.select("stock_code", "trade_date", F.col("net_all").alias("main_net_inflow"), F.col("net_big").alias("big_order_net_inflow"), F.col("net_super").alias("super_large_net_inflow"))


def basic(spark: SparkSession, folder: str) -> DataFrame:
    """Turnover, volume ratio and values of a stock and day; absent on some days."""
    df = slots(spark, folder).filter(_traded() & ((F.col("l_suppkey") + F.col("s")) % 19 != 0))
    return df.select("stock_code", "trade_date", (F.col("volume_hand") / (1 + F.col("l_suppkey") % 10)).alias("turnover_rate"), (F.col("amount_yuan") / 10000).alias("total_mv"), F.when(F.col("s") % 7 != 0, F.col("close_price") / 2).alias("pe"))


def limit_events(spark: SparkSession, folder: str) -> DataFrame:
    """Limit-ups, broken boards, limit-downs, and suspensions where a stock has no bar."""
    df = slots(spark, folder)
    d = F.col("last_discount")
    kind = F.when(~_traded(), "suspend").when(d >= 0.095, "limit_up").when(d >= 0.085, "limit_break").when(d <= 0.005, "limit_down")
    traded = F.col("event_type") != "suspend"
    df = df.withColumn("event_type", kind).filter(F.col("event_type").isNotNull())
    return df.select(
        "stock_code", "trade_date", "event_type", F.when(traded, F.col("base") * 1.1).alias("limit_price"),
        F.when(traded, F.col("last_quantity").cast("long") % 4).cast("int").alias("open_count"), F.when(traded, F.format_string("%02d:%02d:00", F.lit(9) + F.col("last_line") % 6, F.col("last_line") * 7)).alias("first_time"),
    )


def stocks(spark: SparkSession, folder: str) -> DataFrame:
    """The stock master: exchange by parity, a few special-treatment, suspended and excluded ones; listed at the first bar."""
    n = F.col("s_suppkey")
    first = slots(spark, folder).groupBy("stock_code").agg(F.min("trade_date").alias("list_date"))
    df = table(spark, folder, "supplier").withColumn("stock_code", _code("s_suppkey")).join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    df = df.join(first, "stock_code", "left")
    return df.select("stock_code", F.col("s_name").alias("stock_name"), F.when(n % 2 == 0, "SH").otherwise("SZ").alias("exchange"), F.when(n % 37 == 5, "suspended").otherwise("active").alias("status"), (n % 29 == 3).alias("is_st"), F.col("n_name").alias("industry"), F.col("n_regionkey").alias("region_key"), "list_date")


def calendar(spark: SparkSession, folder: str) -> DataFrame:
    """Open days with their number and neighbours."""
    days = slots(spark, folder).agg(F.max("s").alias("n")).select(F.explode(F.sequence(F.lit(1), F.col("n"))).alias("idx"))
    return days.select(F.col("idx").cast("long").alias("idx"), nth_weekday(F.col("idx")).alias("trade_date"), F.when(F.col("idx") > 1, nth_weekday(F.col("idx") - 1)).alias("previous_trade_date"), nth_weekday(F.col("idx") + 1).alias("next_trade_date"))


def members(spark: SparkSession, folder: str) -> DataFrame:
    """Stocks of concepts (brands of the parts they supply), from the first to the last such day."""
    part = table(spark, folder, "part").select("p_partkey", F.col("p_brand").alias("sector_code"))
    df = slots(spark, folder).join(part, F.col("last_part") == F.col("p_partkey"))
    return df.groupBy("sector_code", "stock_code").agg(F.min("trade_date").alias("start_date"), F.when(F.count("*") % 3 != 0, F.max("trade_date")).alias("end_date"))


def minutes(spark: SparkSession, folder: str) -> DataFrame:
    """Minute bars of ten stocks: one for each of their events, in time order."""
    e = table(spark, folder, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.lpad((F.col("user_id") % 10).cast("string"), 6, "0").alias("stock_code"), F.col("ts").cast("date").alias("trade_date"), F.col("ts").alias("bar_time"), "event_id", (10 + F.col("value") / 100).alias("price"), F.when(k % 10 != 0, k).otherwise(0).alias("volume_hand"), ((10 + F.col("value") / 100) * F.when(k % 10 != 0, k).otherwise(0) * 100).alias("amount_yuan"))


def quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes in rounds of an hour: each stock's last event of the hour against its first of the day before."""
    e = table(spark, folder, "events").withColumn("stock_code", F.lpad((F.col("user_id") % 100).cast("string"), 6, "0")).withColumn("round_time", F.date_trunc("hour", "ts"))
    last = e.groupBy("stock_code", "round_time").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("quote_time"), F.max("value").alias("hi"), F.min("value").alias("lo"), F.min_by("value", F.struct("ts", "event_id")).alias("first"), F.count("*").alias("n"))
    price = lambda c: 10 + F.col(c) / 100
    w = Window.partitionBy("stock_code").orderBy("round_time")
    df = last.withColumns({"last_price": price("value"), "open_price": price("first"), "high_price": price("hi"), "low_price": price("lo")})
    df = df.withColumn("pre_close_price", F.lag("last_price").over(w)).filter("pre_close_price is not null")
    return df.select("stock_code", "round_time", "quote_time", "last_price", "pre_close_price", ((F.col("last_price") / F.col("pre_close_price") - 1) * 100).alias("change_pct"), "open_price", "high_price", "low_price", (F.col("n") * 100).alias("volume_share"), (F.col("last_price") * F.col("n") * 100).alias("amount_yuan"), (F.col("pre_close_price") * 1.1).alias("limit_up"), (F.col("pre_close_price") * 0.9).alias("limit_down"))
