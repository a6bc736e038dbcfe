"""Operator 1: mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, n_buckets, prepared, running, stored, table

#: The fractional part of the golden ratio.
GOLDEN = 0.6180339887498949
#: Words of a block.
BLOCK = 2048


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """The words to take of each source.

    sizes: source, source_size; one row a source, so windows over all of them are small.
    Weights repeat over the sources in code point order, null last. They share `share` of all words; a target stops at
    `most` times its source, and the excess is shared again by weight until none is above. Sources that stop are those
    of the least size for their weight, so one pass in that order finds the level at which all others settle.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(in_order) - 1, F.lit(len(weights)))
    df = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place + 1).cast("double"))
    df = df.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    df = df.withColumns({
        "left": share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "weight_left": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    # Going up by ratio, sources stop at their caps while the level that the rest would have is above their ratio;
    # from the first that doesn't stop, the computed levels only fall, so the greatest of them is the true one.
    df = df.withColumn("level", F.col("left") / F.col("weight_left"))
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(whole)
    df = df.withColumn("settled", level)
    return df.select("source", "source_size", "weight", F.when(F.col("settled").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("settled") * F.col("weight"))).alias("target"))


def schedule(spark: SparkSession, goals: DataFrame, block: int, slots: int) -> DataFrame:
    """One row for each block of words in the order of the mix: slot, source, rank among the source's slots, start, stop.

    Slot i has the point frac(i * golden ratio), which falls in one source's part of the cumulative targets, so any run
    of slots holds the sources in proportion. Ranks count a source's slots: within a group of slots by a window, and
    before it by sums of whole groups, so no task holds all slots of a source. The points leave a source a few slots short or over:
    slots over are empty and dropped, those short follow at the end, so that every source gets its target exactly.
    """
    whole, by_source = Window.partitionBy(), Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    parts = goals.filter(F.col("target") > 0).withColumn("words", F.round("target").cast("long"))
    parts = parts.withColumn("to", F.sum("target").over(by_source) / F.sum("target").over(whole)).withColumn("from", F.coalesce(F.lag("to").over(Window.orderBy(F.col("source").asc_nulls_last())), F.lit(0.0)))
    last = F.max("to").over(whole)
    parts = parts.withColumn("to", F.when(F.col("to") >= last, 2.0).otherwise(F.col("to"))).withColumn("need", F.ceil(F.col("words") / block))
    group = 1 << 16
    cells = 1024
    # Sources by the cells of [0, 1) that their parts cover: points meet only the few sources of their cell.
    cover = parts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") * cells), F.least(F.floor(F.col("to") * cells), F.lit(cells - 1)))))
    points = spark.range(slots).select(F.col("id").alias("slot"), (F.col("id") * GOLDEN - F.floor(F.col("id") * GOLDEN)).alias("u")).withColumn("cell", F.floor(F.col("u") * cells))
    drawn = points.join(cover, "cell").filter((F.col("u") >= F.col("from")) & (F.col("u") < F.col("to"))).select("slot", "source", F.floor(F.col("slot") / group).alias("part"))
    drawn = drawn.withColumn("in_part", F.row_number().over(Window.partitionBy("part", "source").orderBy("slot")) - 1)
    sums = drawn.groupBy("source", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ranked = drawn.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).select("slot", "source", (F.col("start") + F.col("in_part")).alias("rank"))
    filled = sums.groupBy("source").agg(F.sum("n").alias("got"))
    short = parts.join(filled.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").filter(F.coalesce("got", F.lit(0)) < F.col("need")).select(F.lit(slots).cast("long").alias("slot"), "source", F.explode(F.sequence(F.coalesce("got", F.lit(0)), F.col("need") - 1)).alias("rank"))
    all_slots = ranked.unionByName(short)
    ends = parts.select(F.col("source").alias("s"), "words", "source_size")
    return all_slots.join(ends, F.col("source").eqNullSafe(F.col("s"))).withColumn("start", F.col("rank") * block).withColumn("stop", F.least(F.col("start") + block, "words")).filter("start < stop").drop("s")


def _laid_out(docs: DataFrame, weights: tuple[int, ...], share: float, most: float, block: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with their place `at` in their source's stream, goals, what slots take: slot, s, a, lo, hi in the stream of source s,
    of the document that begins at a)."""
    spark = prepared(docs.sparkSession)
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = stored(sized.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size")))
    rows, words = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    buckets = n_buckets(rows)
    sizes = sized.groupBy("source", F.pmod("h", F.lit(64)).alias("salt")).agg(F.sum("size").alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = stored(targets(sizes, weights, share, most))
    placed = running(sized, ["source"], [F.col("h"), F.col("doc_id")], F.pmod("h", F.lit(buckets)), "size", "at").withColumn("end", F.col("at") + F.col("size"))
    # What the slots take, by block of the stream: a block has a slot for each pass over the stream.
    taken = schedule(spark, goals, block, int(round(share * words / block)))
    passes = F.explode(F.sequence(F.floor(F.col("start") / F.col("source_size")), F.floor((F.col("stop") - 1) / F.col("source_size"))))
    spans = taken.withColumn("turn", passes).select(
        "slot", "source",
        (F.greatest("start", F.col("turn") * F.col("source_size")) - F.col("turn") * F.col("source_size")).alias("lo"),
        (F.least("stop", (F.col("turn") + 1) * F.col("source_size")) - F.col("turn") * F.col("source_size")).alias("hi"),
    )
    in_blocks = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / block), F.floor((F.col(hi) - 1) / block)))
    cut = lambda lo, hi: (F.greatest(lo, F.col("block") * block), F.least(hi, (F.col("block") + 1) * block))
    # Parts of spans that lie in one block; a block has as many as passes over the stream, and two more at most.
    lo, hi = cut("lo", "hi")
    by_block = spans.withColumn("block", in_blocks("lo", "hi")).withColumns({"lo": lo, "hi": hi}).groupBy(F.col("source").alias("s"), F.col("block").alias("b")).agg(F.collect_list(F.struct("slot", "lo", "hi")).alias("spans"))
    lo, hi = cut("at", "end")
    pieces = placed.filter("size > 0").select("source", "at", "end").withColumn("block", in_blocks("at", "end")).withColumns({"lo": lo, "hi": hi})
    met = pieces.join(by_block, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).select("s", F.col("at").alias("a"), F.col("lo").alias("from"), F.col("hi").alias("to"), F.explode("spans").alias("x"))
    met = met.select("x.slot", "s", "a", F.greatest("from", "x.lo").alias("lo"), F.least("to", "x.hi").alias("hi")).filter("lo < hi")
    return placed, goals, met


def stream(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """The mixed stream: slot, source, doc_id, start, length of each piece, in words. Sorted by (slot, source, doc_id, start), any run
    of slots holds the sources in proportion to their targets.

    A document that lies across blocks is several pieces; one that is taken again has pieces of other slots. Null and empty texts
    have none; an empty table has none.
    """
    placed, _, met = _laid_out(docs, weights, share, most, block, seed)
    found = met.join(placed.filter("size > 0"), F.col("source").eqNullSafe(F.col("s")) & (F.col("at") == F.col("a")))
    return found.select("slot", "source", "doc_id", (F.col("lo") - F.col("at")).alias("start"), (F.col("hi") - F.col("lo")).alias("length"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.0, most: float = 3.0, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """docs (doc_id, source, text) with size, source_size, target, taken, the words the mix takes of each row, and first_slot, the
    first slot that takes some: the documents' order in the mix.

    Each source's documents, shuffled by a hash of their ids, are one stream of words that starts again at its end;
    a slot of the schedule takes the next block of its source's stream. A row's taken words are the lengths of its pieces in
    `stream`, repeats counted; no row exceeds `most` times its size, as no stream is passed more often.

    Null and empty texts have size 0 and take nothing; their first_slot is null, as is that of rows not taken. Null is a source
    like others, last in order. Repeated rows are rows of their own. An empty table gives no rows. Of other columns of docs
    none is kept; join them by doc_id. block: words of a block, at any size of the table.
    """
    placed, goals, met = _laid_out(docs, weights, share, most, block, seed)
    got = met.groupBy("s", "a").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"), F.min("slot").alias("first_slot"))
    both = placed.join(got, F.col("source").eqNullSafe(F.col("s")) & (F.col("at") == F.col("a")) & (F.col("size") > 0), "left").drop("s", "a")
    goal = goals.select(F.col("source").alias("g"), "source_size", F.col("target").cast("double").alias("target"))
    return both.join(goal, F.col("source").eqNullSafe(F.col("g"))).select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


QUERIES = {"op1_mix": op1_mix}
ORACLES: dict[str, str] = {}
