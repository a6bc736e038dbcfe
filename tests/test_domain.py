"""The frame of stock days: how its work grows with the lines."""

import re

import pytest

from tapeline.plans import registry
from tapeline.sources import domain as D

FOLDER = "/root/testdata/sf0.001"


def test_lines_of_stock_days_go_through_one_exchange_in_parts_of_a_bounded_size(spark, monkeypatch):
    """Lines meet their stock once, as wide as they are, and a task's share doesn't grow with the table."""
    plan = D._slots(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    lines = D.table(spark, FOLDER, "lineitem").count()
    monkeypatch.setattr(D, "LINES_A_TASK", 500)
    assert D._slots(spark, FOLDER).rdd.getNumPartitions() == -(-lines // 500) > 4


def test_stock_days_take_their_first_and_last_line_by_order_and_number(spark, tmp_path):
    rows = [(2, 5, 1, 1, 10.0, 100.0, 0.02, 0.01, "A", "2024-01-02"), (1, 6, 1, 2, 41.0, 200.0, 0.10, 0.04, "R", "2024-01-02"), (2, 7, 1, 2, 49.0, 300.0, 0.07, 0.05, "N", "2024-01-02"), (9, 8, 1, 1, 1.0, 50.0, 0.0, 0.0, "A", "2024-01-03")]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_shipdate string"
    df = spark.createDataFrame(rows, names)
    df.withColumn("l_shipdate", df.l_shipdate.cast("timestamp")).write.parquet(str(tmp_path / "lineitem.parquet"))
    a, b = D._slots(spark, str(tmp_path)).orderBy("s").collect()
    assert (a.open_price, a.close_price, a.last_discount, a.last_quantity, a.last_line, a.last_part) == (21 * (1 + (0.04 - 0.04)), 21 * (1 + (0.07 - 0.05) * 2), 0.07, 49.0, 2, 7)
    assert (a.volume_hand, a.amount_yuan, a.net_all, a.net_big, a.net_super) == (100, 600.0, -100.0, -200.0, 0.0) and (b.s, b.last_part, b.stock_code) == (2, 8, "000001")


@pytest.mark.parametrize("name", ["c32_missing_keys", "j05_date_universe", "c22_update_changed", "c20_upsert", "c21_insert_only", "u04_overlap", "c23_merge_features", "q02_gaps", "f10_backfill_window", "w07_guarded"])
def test_frames_of_stock_days_meet_without_an_exchange(spark, name):
    """Rows by stock and day stay where their stock is, also where no side is small enough to be broadcast."""
    conf = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(conf)
    spark.conf.set(conf, "-1")
    try:
        df = registry.QUERIES[name](spark, FOLDER)
        df.collect()
        final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "InMemoryTableScan" in final and not re.findall(r"Exchange hashpartitioning\(stock_code#\d+, trade_date#\d+.*", final)
    finally:
        spark.conf.set(conf, was)


def test_lines_of_stock_days_are_not_held_by_the_writer_of_many_parts(spark):
    """A session's many shuffle partitions don't make Spark's writer hold a map task's lines."""
    conf = "spark.sql.shuffle.partitions"
    was = spark.conf.get(conf)
    spark.conf.set(conf, "432")
    try:
        assert D._slots(spark, FOLDER).rdd.getNumPartitions() == 200
    finally:
        spark.conf.set(conf, was)


def test_rows_of_snapshots_stay_where_their_stock_is(spark):
    """Members are counted in place, and the one chosen date a group is sent to the rows, not the rows to it."""
    conf = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(conf)
    spark.conf.set(conf, "-1")
    try:
        df = registry.QUERIES["c26_complete_snapshot"](spark, FOLDER)
        df.collect()
        final = re.split(r"^\+- == Initial Plan ==", df._jdf.queryExecution().executedPlan().toString(), flags=re.M)[0]
        assert re.search(r"BroadcastHashJoin \[industry#\d+, trade_date#\d+\]", final) and not re.search(r"Exchange hashpartitioning\(industry#\d+, trade_date#\d+, stock_code#\d+", final)
        assert not re.search(r"SortMergeJoin \[industry#\d+, trade_date#\d+\]", final.split("BroadcastExchange")[0])
    finally:
        spark.conf.set(conf, was)


def test_kept_frame_is_in_small_batches(spark):
    """Large batches that a task has read stay on its heap until it ends."""
    df = D.slots(spark, FOLDER)
    rows = df.count()
    kept = df._jdf.queryExecution().withCachedData().cacheBuilder()
    assert rows > 4000 and kept.cachedColumnBuffers().count() >= rows / D.BATCH_ROWS > df.rdd.getNumPartitions()
