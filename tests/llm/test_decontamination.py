"""Benchmark passages in documents against a search word by word."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tapeline.llm import decontamination as de


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(docs, items):
    windows = set()
    for item, text in items:
        w = words(text)
        windows |= {("" if item is None else str(item), tuple(w[i : i + 10])) for i in range(max(len(w) - 9, 1 if w else 0))}
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, window in windows:
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    ids.add(item)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def got(spark, docs, items):
    df = de.decontaminate(docs, items).withColumn("items_sha256", F.sha2(F.array_join("item_ids", ","), 256))
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=str)


def frame(spark, rows, schema):
    clashing = {"key": F.lit("x"), "window": F.lit(1), "pos": F.lit(None).cast("string"), "digest": F.lit(2)}
    return spark.createDataFrame(rows, schema).withColumns(clashing).repartition(3)


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve."), (2, "short passage"), (3, "solo"), (4, "a a a a a a a a a a a"), (5, None), (6, " ... "), (7, "Four five six SEVEN eight nine ten eleven twelve thirteen fourteen"), (10, "three word item"), (None, "nameless item here now"), (1, "another text of the first"), (8, "Ünï çödé 日本語 words éa")]
DOCS = [
    (1, "x one, two THREE four five six seven eight nine ten eleven twelve thirteen fourteen y"), (2, None), (3, ""), (4, " \n"), (5, "solo solo short\tpassage short"), (6, "a " * 5000), (7, "one two three four five six seven eight nine"), (7, "one two three four five six seven eight nine"),
    (8, "nameless-item here_now; another text of the first. ünï çödé 日本語 words éa"), (8, "Ünï çödé 日本語 words éa three word three word item"), (None, "short passage"), (9, "zz " * 30_000 + "one two three four five six seven eight nine ten"),
]


@pytest.mark.parametrize("most", [de.BROADCAST_BYTES, 700])
def test_awkward_rows_in_one_part_and_in_several(spark, monkeypatch, most):
    monkeypatch.setattr(de, "BROADCAST_BYTES", most)
    assert got(spark, frame(spark, DOCS, "doc_id long, text string"), frame(spark, ITEMS, "item_id long, text string")) == slow(DOCS, ITEMS)


def test_random_texts(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice("a b c".split()) for _ in range(rng.randrange(n)))
    docs, items = [(i, text(60)) for i in range(60)], [(i, text(14)) for i in range(8)]
    assert got(spark, frame(spark, docs, "doc_id long, text string"), frame(spark, items, "item_id long, text string")) == slow(docs, items)


def test_empty_tables(spark):
    docs, items = frame(spark, DOCS, "doc_id long, text string"), frame(spark, ITEMS, "item_id long, text string")
    assert got(spark, docs.filter("false"), items) == []
    assert got(spark, docs, items.filter("false")) == slow(DOCS, [])


def test_only_dataframe_functions(spark):
    rows, hits = de.occurrences(frame(spark, DOCS, "doc_id long, text string"), frame(spark, ITEMS, "item_id long, text string"))
    for df in (rows, hits):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
