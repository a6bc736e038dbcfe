"""Canonical tables on files: upserts, retention and backfills that write the partitions they touch and no others; bucketed tables.

A table is a Parquet folder partitioned by one column, usually trade_date. What is written is worked out in full into a staging folder
beside it first: if that fails, the table is as it was. Lists of partitions (days) pass through the driver, rows never do.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge as U

DAY = "trade_date"


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    files, place = _files(spark, path)
    return files.exists(place)


def partitions(spark: SparkSession, path: str, partition: str = DAY) -> dict[str, str]:
    """The table's partitions: value, as its folder is named, to folder. No file is read."""
    files, place = _files(spark, path)
    if not files.exists(place):
        return {}
    names = [s.getPath() for s in files.listStatus(place) if s.isDirectory()]
    return {p.getName().split("=", 1)[1]: p.toString() for p in names if p.getName().startswith(f"{partition}=")}


def drop_partitions(spark: SparkSession, path: str, gone: list[str], partition: str = DAY) -> None:
    for value, folder in partitions(spark, path, partition).items():
        if value in gone:
            files, place = _files(spark, folder)
            files.delete(place, True)


def replace_partitions(df: DataFrame, path: str, touched: list | None = None, partition: str = DAY) -> list[str]:
    """Writes df's rows in place of all rows of the partitions that it has, and empties those of `touched` that it has no rows of.
    Returns the partitions written."""
    spark, staging = df.sparkSession, f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    try:
        df.write.partitionBy(partition).parquet(staging)
        staged = partitions(spark, staging, partition)
        if staged:
            ready = spark.read.schema(df.schema).parquet(staging)
            ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
        drop_partitions(spark, path, [str(v) for v in touched or [] if str(v) not in staged], partition)
        return sorted(staged)
    finally:
        files, place = _files(spark, staging)
        files.delete(place, True)


def _part(spark: SparkSession, path: str, schema, values: list, partition: str) -> DataFrame:
    """The rows of some partitions; the others aren't listed as input."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).filter(F.col(partition).isin(values))


def upsert_table(new: DataFrame, path: str, keys: list[str], order: list[Column], mode: str = "update", partition: str = DAY) -> list[str]:
    """`merge.upsert` of new into the table; reads and writes the partitions that new has. keys hold the partition's column."""
    touched = [r[0] for r in new.select(partition).distinct().collect()]
    old = _part(new.sparkSession, path, new.schema, touched, partition)
    return replace_partitions(U.upsert(old, new, keys, order, mode).select(new.columns), path, None, partition)


def update_table(src: DataFrame, path: str, keys: list[str], column: str, partition: str = DAY) -> list[str]:
    """`merge.update_changed` of the table; only partitions in which a value changes are written."""
    spark = src.sparkSession
    table = spark.read.parquet(path)
    some = table.filter(F.col(partition).isin([r[0] for r in src.select(partition).distinct().collect()]))
    changed = [r[0] for r in U.update_changed(some, src, keys, column).filter("changed").select(partition).distinct().collect()]
    if not changed:
        return []
    return replace_partitions(U.update_changed(table.filter(F.col(partition).isin(changed)), src, keys, column).drop("changed"), path, None, partition)


def retain(spark: SparkSession, path: str, calendar: DataFrame, n: int, partition: str = DAY) -> list[str]:
    """Drops the partitions before the n-th newest open day; none if there are fewer. No file is read or written."""
    cutoff = U.retention_cutoff(calendar, n).first()["cutoff"]
    gone = sorted(v for v in partitions(spark, path, partition) if cutoff is not None and v < str(cutoff))
    drop_partitions(spark, path, gone, partition)
    return gone


def clear_table(spark: SparkSession, path: str, start: str, end: str, keys: DataFrame | None = None, partition: str = DAY) -> list[str]:
    """`merge.clear_range` of the table: drops the partitions of the range, or writes them anew without the rows of keys."""
    inside = sorted(v for v in partitions(spark, path, partition) if start <= v <= end)
    if keys is None:
        drop_partitions(spark, path, inside, partition)
    elif inside:
        table = spark.read.parquet(path)
        replace_partitions(U.clear_range(table.filter(F.col(partition).between(start, end)), start, end, keys).select(table.columns), path, inside, partition)
    return inside


# ---- backfills


def windows(days: list[date], width: int) -> list[list[date]]:
    """The days in order, in windows of at most `width`."""
    days = sorted(days)
    return [days[i : i + width] for i in range(0, len(days), width)]


def missing_days(spark: SparkSession, bars: DataFrame, path: str, start: date, end: date, rebuild: bool = False) -> list[date]:
    """Days of the range on which the table lacks stocks that have a bar; with rebuild, all days with bars. One row a day."""
    keys = bars.filter(F.col(DAY).between(start, end)).select("stock_code", DAY)
    if not rebuild and exists(spark, path):
        keys = U.missing_keys(keys, spark.read.parquet(path).filter(F.col(DAY).between(start, end)), ["stock_code", DAY])
    return sorted(r[0] for r in keys.select(DAY).distinct().collect())


def window_input(bars: DataFrame, window: list[date], look_back: int) -> DataFrame:
    """The bars that a window's factors need: its days and look_back calendar days before; the filter goes to the scan."""
    return bars.filter(F.col(DAY).between(window[0] - timedelta(days=look_back), window[-1]))


def backfill(spark: SparkSession, bars: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], start: date, end: date, width: int = 20, look_back: int = 550, rebuild: bool = False) -> list[list[date]]:
    """Fills the table at path with compute(bars) for the days of the range that lack it; returns the windows written.

    Days are taken in windows of `width`. Each is worked out from its own bars and those of look_back days before only, and written as a
    unit: a run that breaks off leaves whole windows, which the next run doesn't find missing. What compute counts over all history (such
    as listing age) it counts from the look-back on; every window it uses must fit in there.
    """
    done = []
    for window in windows(missing_days(spark, bars, path, start, end, rebuild), width):
        result = compute(window_input(bars, window, look_back)).filter(F.col(DAY).isin(window))
        replace_partitions(result, path)
        done.append(window)
    return done


# ---- bucketed tables


def save_bucketed(df: DataFrame, name: str, buckets: int = 64, key: str = "stock_code", order: str = DAY) -> DataFrame:
    """Saves df as table `name`, bucketed by key and sorted within; it outlives the session. Windows by key over it need no exchange, and
    neither do joins of such tables by keys that begin with it, where spark.sql.requireAllClusterKeysForCoPartition is false."""
    df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key, order).saveAsTable(name)
    return df.sparkSession.table(name)
