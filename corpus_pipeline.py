"""Stages that turn `documents` into packed training sequences. Each works on all that the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm import jaccard, mixing, packing, pii, toxicity
from tapeline.llm.common import prepared, stored, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity field doesn't take for toxic; null and empty texts stay. Each row of a repeated doc_id is judged by its own text.

    Whole texts are judged; without labels all stay; an empty table gives no rows; columns beside those of documents are dropped.
    """
    return toxicity.clean(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of 0.8 or more over five-word shingles join, the document of the smallest id.

    A document is a doc_id and a text, so unlike texts of one doc_id are judged apart; null comes after all ids. Texts without words are in no group and stay.
    Repeated rows of a kept document stay too. An empty table gives no rows; columns beside those of documents are dropped.
    """
    key = F.xxhash64("doc_id", "text")
    found = jaccard.similar(docs.select(key.alias("doc_id"), "text"), k=5, percent=80)
    members = stored(found.filter(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("key"), F.col("component_id").alias("component")).distinct())
    members = members.union(members.select("component", "component").distinct())
    named = docs.select(key.alias("key"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key.alias("key")).alias("who")).join(members, "key")
    gone = members.join(named.groupBy("component").agg(F.min("who").alias("stays")), "component").filter(F.col("key") != F.col("stays.key")).select("key")
    return docs.select(*COLUMNS, key.alias("key")).join(gone, "key", "left_anti").select(COLUMNS)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by pseudonyms; n_chars follows the text where something was replaced.

    Null and empty texts stay as they are, repeated rows too; an empty table gives no rows; columns beside those of documents are dropped.
    """
    return pii.pseudonymise(docs.select(COLUMNS)).withColumn("n_chars", F.when(F.col("n_replaced") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: its taken words over its words, rounded half up; none for those not taken.

    A source's taken words are whole passes and one part of a pass, so only the document that the part ends in is rounded.
    Rows are numbered in a table of the checkpoint folder first, so rows without a doc_id, or of one doc_id, are rows of their own.
    Texts without words are never taken; an empty table gives no rows; columns beside those of documents are dropped.
    """
    rows = written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")))
    plan = mixing.mix(rows.select(F.col("row").alias("doc_id"), "source", "text")).filter("taken > 0")
    plan = plan.select(F.col("doc_id").alias("row"), F.floor(F.col("taken") / F.col("size") + 0.5).cast("int").alias("times")).filter("times > 0")
    return rows.join(plan, "row").withColumn("_", F.explode(F.sequence(F.lit(1), F.col("times")))).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with the sequence they go to and their place in it.

    A null or empty text is one piece, the end id; repeated rows are packed once each; an empty table gives no rows.
    """
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("pii", replace_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can express neither the learned stage nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What each stage kept is written to the shared checkpoint folder and read again."""
    prepared(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
