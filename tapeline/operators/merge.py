"""Merging into canonical tables as DataFrames: write results with dynamic partition overwrite, never over what is being read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order; give a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def canonical_rows(df: DataFrame, keys: list[str], priority: list[str], newest: str = "updated_at", last: str | None = None) -> DataFrame:
    """One row a key: the source that is first in the priority, then the newest, then the greatest of `last`."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, priority)), F.col("source")), F.lit(0))
    return latest_per_key(df, keys, [F.when(place == 0, len(priority) + 1).otherwise(place), F.desc_nulls_last(newest), *([F.desc_nulls_last(last)] if last else [])])


def upsert(target: DataFrame, new: DataFrame, keys: list[str], order: list[Column], mode: str = "update") -> DataFrame:
    """target with new's rows, of which the first of each key in the order counts (rows have none of their own): in mode update
    they replace those of their key, in mode insert_only they come only where there is none."""
    new = latest_per_key(new, keys, order)
    if mode == "insert_only":
        return target.unionByName(new.join(target.select(keys), keys, "left_anti"))
    return target.join(new.select(keys), keys, "left_anti").unionByName(new)


def update_changed(target: DataFrame, src: DataFrame, keys: list[str], column: str) -> DataFrame:
    """target with `column` from src where src has a row of the key and another value; changed says where."""
    s = src.select(*keys, F.col(column).alias("_v"), F.lit(True).alias("_has"))
    df = target.join(s, keys, "left")
    differs = F.coalesce("_has", F.lit(False)) & ~F.col(column).eqNullSafe(F.col("_v"))
    return df.withColumns({column: F.when(differs, F.col("_v")).otherwise(F.col(column)), "changed": differs}).drop("_v", "_has")


def merge_features(target: DataFrame, patch: DataFrame, keys: list[str], column: str = "features") -> DataFrame:
    """Maps of target overlaid by those of patch, where the patch isn't empty."""
    p = patch.select(*keys, F.col(column).alias("_p"))
    old = F.map_filter(F.col(column), lambda k, _: ~F.array_contains(F.map_keys("_p"), k))
    return target.join(p, keys, "left").withColumn(column, F.when(F.size("_p") > 0, F.map_concat(old, "_p")).otherwise(F.col(column))).drop("_p")


def sync_membership(current: DataFrame, snapshot: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys and action: inserted, updated, unchanged or deleted, by a hash of the values; the snapshot is complete."""
    h = lambda df, name: df.select(*keys, F.sha2(F.to_json(F.struct(*values)), 256).alias(name))
    df = h(current, "_old").join(h(snapshot, "_new"), keys, "full")
    return df.select(*keys, F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "deleted").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("updated").alias("action"))


def scd2_apply(current: DataFrame, snapshot: DataFrame, keys: list[str], as_of: str) -> DataFrame:
    """History after a snapshot: open rows that aren't in it close, new ones open, the rest stays. valid_to is null while open."""
    day = F.lit(as_of).cast("date")
    opened = current.filter("valid_to is null")
    gone = opened.join(snapshot.select(keys).distinct(), keys, "left_anti").withColumn("valid_to", day)
    stay = opened.join(snapshot.select(keys).distinct(), keys, "left_semi")
    new = snapshot.select(keys).distinct().join(opened.select(keys), keys, "left_anti").select(*keys, day.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    columns = [*keys, "valid_from", "valid_to"]
    return current.filter("valid_to is not null").select(columns).unionByName(gone.select(columns)).unionByName(stay.select(columns)).unionByName(new)


def latest_complete_snapshot(df: DataFrame, by: str, date: str, member: str, expected: int) -> DataFrame:
    """The members of each `by` on its newest date with at least `expected` of them, else on its newest date; pruned counts the repeated rows that went."""
    rows = df.groupBy(by, date, member).agg(F.count("*").alias("_n"))
    days = rows.groupBy(by, date).agg(F.count(member).alias("_m"), F.sum("_n").alias("_rows"))
    best = days.groupBy(by).agg(F.coalesce(F.max(F.when(F.col("_m") >= expected, F.col(date))), F.max(date)).alias(date))
    chosen = best.join(days, [by, date]).withColumn("pruned", F.col("_rows") - F.col("_m")).drop("_m", "_rows")
    return df.join(F.broadcast(chosen), [by, date]).dropDuplicates([by, date, member])  # one row for each `by`


def compact(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """All rows with kept: whether it is its key's first; the others are the conflict archive."""
    return df.withColumn("kept", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def normalize_units(df: DataFrame, columns: list[str], scale: float = 10000, marker: str = "unit", unit: str = "yuan") -> DataFrame:
    """Values of rows without the marker are scaled and the row marked; running it again changes nothing."""
    bare = F.col(marker).isNull()
    return df.withColumns({**{c: F.when(bare, F.col(c) * scale).otherwise(F.col(c)) for c in columns}, marker: F.coalesce(marker, F.lit(unit))})


def migrate_legacy(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of old tables by source, with the adjustment that the source's name says; use its counts to check."""
    out = None
    for source, df in tables.items():
        part = df.select("stock_code", "trade_date", "close_price", F.lit(source).alias("source"), F.lit("qfq" if "qfq" in source else "none").alias("adjust_mode"))
        out = part if out is None else out.unionByName(part)
    return out


def retention_cutoff(calendar: DataFrame, n: int) -> DataFrame:
    """One row: the n-th newest open day, or null if there are fewer."""
    last = calendar.select("trade_date").orderBy(F.desc("trade_date")).limit(n)
    return last.agg(F.when(F.count("*") == n, F.min("trade_date")).alias("cutoff"))


def prune(df: DataFrame, calendar: DataFrame, n: int) -> DataFrame:
    """Rows not before the cutoff; all if there is none."""
    return df.crossJoin(F.broadcast(retention_cutoff(calendar, n))).filter("cutoff is null or trade_date >= cutoff").drop("cutoff")  # one row


def clear_range(df: DataFrame, start: str, end: str, keys: DataFrame | None = None) -> DataFrame:
    """df without the days of the range, or without those of the given keys only."""
    inside = F.col("trade_date").between(start, end)
    if keys is None:
        return df.filter(~inside)
    return df.join(keys.distinct().withColumn("_k", F.lit(True)), keys.columns, "left").filter(F.col("_k").isNull() | ~inside).drop("_k")


def missing_keys(bars: DataFrame, ready: DataFrame, keys: list[str]) -> DataFrame:
    return bars.select(keys).distinct().join(ready.select(keys), keys, "left_anti")


def completion(audit: DataFrame) -> DataFrame:
    """By day: capabilities captured, and those whose day has no rows and should have none."""
    done = F.col("status").isin("captured", "complete_zero")
    return audit.filter(done).groupBy("trade_date").agg(F.array_join(F.array_sort(F.collect_set("capability")), ",").alias("capabilities"), F.count_if(F.col("status") == "complete_zero").alias("zero_days"))
