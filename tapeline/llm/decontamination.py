"""Operator 13: words of documents that lie within passages of a benchmark. DataFrame functions only."""

from __future__ import annotations

import math
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prepared, stored, table

#: What lies between words, once A-Z are in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Words of a shingle; a window with fewer words is one shingle.
SHINGLE = 4
#: Bytes of benchmark shingles that are broadcast at once. More are dealt into parts of this size, and documents read once a part.
BROADCAST_BYTES = 32 << 20


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase), BETWEEN), "")


def windows_of(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, window (its words with spaces between), m (how many): every `size` consecutive words of an item, or all if it has fewer."""
    cut = items.select("item_id", words_of(F.col("text")).alias("_w")).filter(F.size("_w") > 0)
    at = cut.select("item_id", "_w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("_w") - size, F.lit(0)))).alias("_i"))
    return at.select("item_id", F.array_join(F.slice("_w", F.col("_i") + 1, F.lit(size)), " ").alias("window"), F.least(F.size("_w"), F.lit(size)).alias("m")).distinct()


def shingles_of(windows: DataFrame, k: int = SHINGLE) -> DataFrame:
    """window, m, o (offset), shingle, length: all runs of k words of a window, or the window if it is shorter."""
    w = F.split("window", " ")
    at = windows.select("window", "m").distinct().withColumn("o", F.explode(F.sequence(F.lit(0), F.greatest(F.col("m") - k, F.lit(0)))))
    return at.select("window", "m", "o", F.array_join(F.slice(w, F.col("o") + 1, F.lit(k)), " ").alias("shingle"), F.least("m", F.lit(k)).alias("length"))


def _key(words: list[Column]) -> Column:
    return F.xxhash64(*words)


def _occurrences(docs: DataFrame, shingles: DataFrame, lengths: list[int], parts: int) -> DataFrame:
    """doc_id, digest, n_words, pos, key, near, first: a row for each document (pos -1) and each place of a benchmark shingle.

    A key is a hash; the words behind it are compared as well. near are the words about it as far as a window with the shingle can reach, first the place of the first of them. Documents
    go through one map stage: neither their texts nor their words are shuffled.
    """
    cut = docs.select("doc_id", F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias("digest"), words_of(F.col("text")).alias("w"))
    cut = cut.withColumn("n_words", F.size("w")).withColumn("pos", F.explode(F.sequence(F.lit(-1), F.col("n_words") - 1)))
    word = [F.get("w", F.col("pos") + i) for i in range(max(lengths, default=0))]
    keys = [F.when(F.col("pos") < 0, F.lit(0).cast("long") if n == lengths[0] else None).when(F.col("pos") + n <= F.col("n_words"), _key(word[:n])) for n in lengths]
    cut = cut.withColumn("n", F.explode(F.array(*map(F.lit, lengths)))) if len(lengths) > 1 else cut.withColumn("n", F.lit(lengths[0] if lengths else 0))
    key = reduce(lambda rest, x: F.when(F.col("n") == x[0], x[1]).otherwise(rest), zip(lengths, keys, strict=True), F.lit(0).cast("long"))
    cut = cut.withColumn("key", key)
    mark = shingles.sparkSession.range(1).select(F.lit(0).cast("long").alias("id"), F.lit(None).cast("string").alias("shingle"), F.lit(lengths[0] if lengths else 0).alias("length"), F.lit(0).alias("before"), F.lit(0).alias("after"))
    same = F.when(F.col("pos") < 0, F.col("shingle").isNull()).otherwise(F.array_join(F.slice("w", F.col("pos") + 1, F.col("n")), " ") == F.col("shingle"))
    first = F.greatest(F.col("pos") - F.col("before"), F.lit(0))
    found = []
    for part in range(parts):
        some = shingles.filter(F.pmod("id", F.lit(parts)) == part) if parts > 1 else shingles
        some = some.unionByName(mark) if part == 0 else some
        hit = cut.join(F.broadcast(some), (F.col("key") == F.col("id")) & same)
        found.append(hit.select("doc_id", "digest", "n_words", "pos", "key", F.when(F.col("pos") >= 0, F.slice("w", first + 1, F.col("pos") - first + F.col("length") + F.col("after"))).alias("near"), first.alias("first")))
    return reduce(DataFrame.unionByName, found)


def occurrences(docs: DataFrame, items: DataFrame, size: int = WINDOW, k: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(one row a document: doc_id, digest, n_words; digest, start, m, window: each occurrence of an item's window in a text).

    A prefix-filtered set join. A window occurs only where all its shingles do, so one necessary token is enough to look for:
    the rarest of them by counts over all documents. Its place and the document's length bound where the window can lie, and
    the words there are compared one by one. Equal texts (by digest) are searched once.
    """
    prepared(docs.sparkSession)
    windows = windows_of(items, size)
    parts_of = stored(shingles_of(windows, k).withColumn("id", _key_of_text("shingle", k)))
    reach = F.col("m") - F.col("length")
    shingles = parts_of.groupBy("id", "shingle", "length").agg(F.max("o").alias("before"), F.max(reach - F.col("o")).alias("after"))
    summary = shingles.groupBy("length").agg(F.sum(F.octet_length("shingle") + 48).alias("bytes")).collect()  # at most k rows
    lengths, total = sorted(r["length"] for r in summary), sum(r["bytes"] for r in summary)
    parts = max(1, math.ceil(total / BROADCAST_BYTES))
    found = stored(_occurrences(docs, shingles, lengths, parts))
    places = found.filter("pos >= 0").groupBy("digest", "pos", "key").agg(F.first("n_words").alias("n_words"), F.first("near").alias("near"), F.first("first").alias("first"), F.count("*").alias("copies"))
    places = stored(places)
    counts = places.groupBy("key").agg(F.sum("copies").alias("count"))
    rarity = parts_of.join(counts, parts_of["id"] == counts["key"], "left").groupBy("window", "m").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "o", "id")).alias("_"))
    prefix = rarity.filter("_.count > 0").select("window", "m", "_.o", "_.id")  # a window with a shingle that is nowhere is nowhere
    prefix = F.broadcast(prefix) if parts == 1 else prefix
    start = F.col("pos") - F.col("o")
    fits = (start >= 0) & (start + F.col("m") <= F.col("n_words"))
    exact = F.array_join(F.slice("near", F.greatest(start - F.col("first"), F.lit(0)) + 1, F.col("m")), " ") == F.col("window")
    hits = places.join(prefix, (F.col("key") == F.col("id")) & fits & exact).select("digest", start.alias("start"), "m", "window").distinct()
    return found.filter("pos < 0").select("doc_id", "digest", "n_words"), hits


def _key_of_text(shingle: str, k: int) -> Column:
    w = F.split(shingle, " ")
    return reduce(lambda rest, n: F.when(F.size(w) == n, _key([F.get(w, F.lit(i)) for i in range(n)])).otherwise(rest), range(1, k + 1), F.lit(None).cast("long"))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = WINDOW, k: int = SHINGLE) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_hit, n_items, item_ids, contaminated.

    n_hit counts words within any window of items (item_id, text), n_items and item_ids (as sorted strings) the items that have
    one; rows of one item_id are one item, and one without item_id counts as an item with the name ''. Null and empty texts have no words and hit nothing, an item without
    words has no window. Repeated rows are rows of their own; other columns aren't kept; without items nothing is hit; an empty
    table gives no rows.
    """
    spread = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    rows, hits = occurrences(docs, spread, size, k)
    hits = stored(hits)
    # Of windows at one start the longest counts; a word is counted with the first window that holds it.
    longest = hits.groupBy("digest", "start").agg(F.max("m").alias("m"))
    before = Window.partitionBy("digest").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # no more rows than a text has words
    end = F.col("start") + F.col("m")
    new = F.greatest(end - F.greatest("start", F.coalesce(F.max(end).over(before), F.lit(0))), F.lit(0))
    hit = longest.withColumn("new", new).groupBy("digest").agg(F.sum("new").alias("n_hit"))
    named = hits.select("digest", "window").distinct().join(windows_of(spread, size).select("window", "item_id"), "window").groupBy("digest").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    # A table of its own, so that the join with all documents is one that Spark can split where a text has very many copies.
    out = rows.join(stored(hit.join(named, "digest")), "digest", "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", none).alias("item_ids"), F.col("n_hit").isNotNull().alias("contaminated"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("items_sha256", F.sha2(F.array_join("item_ids", ","), 256)).drop("item_ids")


QUERIES = {"op13_decontaminate": op13_decontaminate}
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES = {
    "op13_decontaminate": f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS} AS w FROM benchmark),
win AS MATERIALIZED (SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i + 1 : i + 10], ' ') AS s
    FROM (SELECT item_id, w, unnest(generate_series(0, greatest(len(w) - 10, 0))) AS i FROM b WHERE len(w) > 0)),
place AS (SELECT rid, w, m, unnest(generate_series(0, len(w) - m)) AS i FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m),
hit AS MATERIALIZED (SELECT rid, i, p.m, win.item_id FROM (SELECT rid, i, m, array_to_string(w[i + 1 : i + m], ' ') AS s FROM place) p JOIN win ON win.s = p.s AND win.m = p.m),
n AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + m - 1)) AS p FROM hit) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN t USING (rid)"""
}
