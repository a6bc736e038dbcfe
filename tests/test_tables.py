"""Tables on files: what is touched is written, all else keeps its files; backfills go on where they broke off; buckets spare exchanges."""

import os
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tapeline.operators import factors as X
from tapeline.operators import merge as U
from tapeline.sources import tables as T

SCHEMA = "stock_code string, close double, trade_date date"
DAYS = [date(2024, 1, 1) + timedelta(days=i) for i in range(6)]
KEY = ["stock_code", "trade_date"]


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "bars")
    T.replace_partitions(spark.createDataFrame([(f"{c}", 1.0 * c, d) for c in range(3) for d in DAYS], SCHEMA), path)
    return path


def files(path):
    return {d: sorted((f, os.stat(f"{path}/{d}/{f}").st_mtime_ns) for f in os.listdir(f"{path}/{d}") if f.endswith("parquet")) for d in os.listdir(path) if "=" in d}


def rows(spark, path):
    return sorted(tuple(r) for r in spark.read.schema(SCHEMA).parquet(path).collect())


def test_upsert_writes_the_touched_partitions_only(spark, table):
    before, old = files(table), spark.createDataFrame(rows(spark, table), SCHEMA)
    new = spark.createDataFrame([("1", 9.0, DAYS[2]), ("1", 8.0, DAYS[2]), ("7", 7.0, DAYS[4]), ("7", 7.0, date(2024, 2, 1))], SCHEMA)
    assert T.upsert_table(new, table, KEY, [F.desc("close")]) == ["2024-01-03", "2024-01-05", "2024-02-01"]
    after = files(table)
    assert {d for d in before if before[d] != after[d]} == {"trade_date=2024-01-03", "trade_date=2024-01-05"}
    assert rows(spark, table) == sorted(tuple(r) for r in U.upsert(old, new, KEY, [F.desc("close")]).select("stock_code", "close", "trade_date").collect())
    T.upsert_table(new.withColumn("close", F.lit(0.0)).unionByName(spark.createDataFrame([("8", 1.0, DAYS[2])], SCHEMA)), table, KEY, [F.desc("close")], "insert_only")
    got = {(r[0], r[2]): r[1] for r in rows(spark, table)}
    assert got["1", DAYS[2]] == 9.0 and got["8", DAYS[2]] == 1.0
    assert not [x for x in os.listdir(os.path.dirname(table)) if "staging" in x]


def test_a_failure_leaves_the_table(spark, table):
    before, old = files(table), rows(spark, table)
    bad = spark.createDataFrame([("1", 9.0, DAYS[2]), ("2", 9.0, DAYS[3])], SCHEMA)
    bad = bad.withColumn("close", F.when(F.col("stock_code") == "2", F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("close")))
    with pytest.raises(Exception, match="broken"):
        T.upsert_table(bad, table, KEY, [F.col("stock_code")])
    assert files(table) == before and rows(spark, table) == old
    assert not [x for x in os.listdir(os.path.dirname(table)) if "staging" in x]


def test_updates_of_changed_values_only(spark, table):
    before = files(table)
    src = spark.createDataFrame([("1", 1.0, DAYS[0]), ("1", 5.0, DAYS[1]), ("9", 5.0, DAYS[2])], SCHEMA)
    assert T.update_table(src, table, KEY, "close") == ["2024-01-02"]
    assert {d for d, f in files(table).items() if before[d] != f} == {"trade_date=2024-01-02"}
    assert T.update_table(src, table, KEY, "close") == []


def test_retention_and_clearing(spark, table):
    calendar = spark.createDataFrame([(d,) for d in DAYS], "trade_date date")
    before = files(table)
    assert T.retain(spark, table, calendar, 9) == []
    assert T.retain(spark, table, calendar, 4) == ["2024-01-01", "2024-01-02"]
    assert files(table) == {d: f for d, f in before.items() if d > "trade_date=2024-01-02"}
    assert T.clear_table(spark, table, "2024-01-03", "2024-01-03") == ["2024-01-03"]
    gone = spark.createDataFrame([("0",), ("1",)], "stock_code string")
    T.clear_table(spark, table, "2024-01-04", "2024-01-05", gone)
    assert {(r[0], r[2]) for r in rows(spark, table)} == {("2", DAYS[3]), ("2", DAYS[4]), *((f"{c}", DAYS[5]) for c in range(3))}
    T.clear_table(spark, table, "2024-01-05", "2024-01-05", spark.createDataFrame([("2",)], "stock_code string"))
    assert "2024-01-05" not in T.partitions(spark, table)  # a partition that is left without rows goes


@pytest.fixture(scope="module")
def bars(spark, tmp_path_factory):
    rng, path = random.Random(5), str(tmp_path_factory.mktemp("b") / "bars")
    out = []
    for c in range(4):
        close = 10.0
        for i in range(150):
            last, close = close, round(close * (1 + rng.uniform(-0.05, 0.05)), 3)
            if rng.random() > 0.05:
                out.append((f"{c}", date(2024, 1, 1) + timedelta(days=i), close * 0.99, close * 1.02, close * 0.97, close, last, rng.randrange(100, 900), close * 1000))
    df = spark.createDataFrame(out, "stock_code string, trade_date date, open_price double, high_price double, low_price double, close_price double, pre_close_price double, volume_hand long, amount_yuan double")
    df.coalesce(1).write.partitionBy("trade_date").parquet(path)
    return spark.read.parquet(path)


def test_backfill_goes_on_where_it_broke_off_and_equals_the_whole_run(spark, bars, tmp_path):
    path, calls = str(tmp_path / "f"), []
    start, end = date(2024, 4, 20), date(2024, 5, 24)

    def compute(df, fail=2):
        calls.append(df)
        if len(calls) == fail:
            raise RuntimeError("lost")
        return X.daily_factors(df).drop("history_days")

    with pytest.raises(RuntimeError):
        T.backfill(spark, bars, path, compute, start, end, 10, 90)
    assert len(T.partitions(spark, path)) == 10
    first = files(path)
    done = T.backfill(spark, bars, path, lambda df: compute(df, 0), start, end, 10, 90)
    assert [len(w) for w in done] == [10, 10, 5] and all(files(path)[d] == f for d, f in first.items())
    assert T.backfill(spark, bars, path, compute, start, end, 10, 90) == []
    whole = X.daily_factors(bars).drop("history_days").filter(F.col("trade_date").between(start, end))
    columns = whole.columns
    assert sorted(map(tuple, spark.read.parquet(path).select(columns).collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    # One stock's day is lost: only that day's window is worked out again.
    day = bars.filter("stock_code = '1' and trade_date > '2024-05-01'").agg(F.min("trade_date")).first()[0]
    T.clear_table(spark, path, str(day), str(day), spark.createDataFrame([("1",)], "stock_code string"))
    assert T.backfill(spark, bars, path, lambda df: compute(df, 0), start, end, 10, 90) == [[day]]
    plan = T.window_input(bars, [start, start + timedelta(days=9)], 90)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(trade_date" in plan and "2024-01-21" in plan and "2024-04-29" in plan


def test_bucketed_tables_need_no_exchange(spark, bars):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition")
    before = [spark.conf.get(n) for n in names]
    made = []
    try:
        for n, v in zip(names, ("-1", "false"), strict=True):
            spark.conf.set(n, v)
        key = ["stock_code", "trade_date"]
        frames = [bars, bars.select(*key, (F.col("close_price") / 10).alias("adj_factor")), bars.select(*key, F.lit(1.0).alias("turnover_rate"), F.lit(2.0).alias("pe"), F.lit(3.0).alias("total_mv")), bars.select(*key, F.lit(5.0).alias("main_net_inflow"), F.lit(4.0).alias("big_order_net_inflow"), F.lit(3.0).alias("super_large_net_inflow"))]
        for i, df in enumerate(frames):
            made.append(T.save_bucketed(df, f"tapeline_test_{i}", 4))
        df = X.daily_factors_v2(*made)
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        plain = X.daily_factors_v2(*frames)
        assert sorted(map(str, df.collect())) == sorted(map(str, plain.collect()))
    finally:
        for i in range(len(made)):
            spark.sql(f"drop table tapeline_test_{i}")
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
