"""Stages of the pipeline on rows without ids, of one id, repeated, on awkward texts and on empty tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tapeline.llm import language, mixing, quality

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = "one two three four five six seven eight nine ten"
AWKWARD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, PASSAGE, "en", "a", 3), (5, PASSAGE, "en", "b", 3), (5, "quite another text of six words", "en", "b", 3), (None, "a text without an id here", "en", None, 9),
    (None, "another text without an id there", "en", "a", 9), (6, "long " * 30_000, "en", "b", 150_000), (7, "repeated row of seven words in all", "fr", "c", 1), (7, "repeated row of seven words in all", "fr", "c", 1), (8, "\0 Ünï 日本語", "fr", "c", 1),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumns({"key": F.lit("x"), "row": F.lit(1), "component": F.lit(None).cast("string"), "size": F.lit(2)}).repartition(2)


def ids(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_each_stage_on_awkward_rows_and_empty_tables(spark, tmp_path):
    docs, columns = frame(spark, AWKWARD), {c.split()[0] for c in DOCS.split(", ")}
    for k, (name, stage) in enumerate(cp.STAGES):
        empty = stage(spark, frame(spark, []), FOLDER)
        assert empty.count() == 0
        out = stage(spark, docs, FOLDER)
        assert name == "packing" or set(out.columns) == set(empty.columns) == columns
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        assert out.count() > 0
        docs = out


def test_near_copies_go_by_text_and_not_by_id(spark):
    kept = ids(cp.drop_near_copies(spark, frame(spark, AWKWARD), FOLDER))
    assert kept == Counter((r[0], r[1]) for r in AWKWARD) - Counter({(5, PASSAGE): 1})
    many = [(9, PASSAGE, "en", "a", 1)] * 3000 + [(4, PASSAGE + " eleven", "en", "a", 1), (9, "unlike text of one id that is repeated", "en", "a", 1)]
    assert set(ids(cp.drop_near_copies(spark, frame(spark, many), FOLDER))) == {(4, PASSAGE + " eleven"), (9, many[-1][1])}


def test_mixing_keeps_rows_without_ids_and_rows_of_one_id_apart(spark):
    rows = [(None, "w " * 40, "en", "a", 1), (None, "v " * 40, "en", "a", 1), (1, "u " * 40, "en", "a", 1), (1, "t " * 10, "en", "b", 1), *[(2, "s " * 10, "en", "b", 1)] * 5]
    docs = frame(spark, rows)
    plan = mixing.mix(docs.withColumn("doc_id", F.xxhash64("doc_id", "text"))).groupBy("doc_id").agg(F.sum(F.floor(F.col("taken") / F.col("size") + 0.5)).alias("n"))
    want = {r.doc_id: r.n for r in plan.collect()}
    out = cp.mix_sources(spark, docs, FOLDER)
    got = {r.k: r.n for r in out.groupBy(F.xxhash64("doc_id", "text").alias("k")).agg(F.count("*").alias("n")).collect()}
    assert sum(got.values()) == pytest.approx(sum(want.values()), abs=2)  # rows are shuffled by another id, so a pass can end in another row
    words = {r.source: r.n for r in out.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).collect()}
    target = {r.source: r.target for r in mixing.mix(docs).collect()}
    assert all(abs(words[s] - target[s]) <= 40 for s in target)
    assert {(r.doc_id, r.text) for r in out.collect()} == {(r[0], r[1]) for r in rows}


def test_an_id_of_most_rows_takes_one_place_in_the_sample(spark, monkeypatch):
    docs = [r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang").collect()]
    first = spark.createDataFrame([(i,) for i in range(2000, 4000)], "doc_id long").filter("pmod(crc32(cast(doc_id as string)), 4) <> 2").orderBy(F.xxhash64("doc_id")).first().doc_id
    seen = []
    monkeypatch.setattr(language, "fitted", lambda known, target, fit: seen.append(known.count()) or quality.fitted(known.limit(0), target, fit))
    many = spark.createDataFrame(docs + [(first, "un texte", "fr")] * 3000, "doc_id long, text string, lang string")
    language.identify(many, rows=100)
    assert seen == [100]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(5000, 9000)] + [(r.doc_id, 1, 0) for r in docs], "doc_id long, quality int, toxic int")
    own = quality.sample(many, labels, "quality", 50)
    assert own.count() == 50
