"""Operator 6: links and components of documents by the Jaccard similarity of their word n-grams.

Adaptive multi-match prefixes. All shingles stand in one order, rare ones first. Two documents similar enough share at
least l of the first n - least + l shingles of each, where least is the smallest overlap that the document needs: its
l-prefix. A longer prefix costs more postings but, as more shared shingles are asked for, leaves fewer candidates; each
document takes the l whose estimated cost is least, and a pair must share what the prefixes of both leave open.

The order: shingles whose hash lies in the lowest part of the hash space come first, by the number of documents that they
are in, counted exactly over all documents; the rest follow by hash. The part is wide enough to hold nearly every prefix, so
the others, most of all shingles, never leave the task that reads the text. A shingle of one document only takes a place
in its prefix but needs no posting.

Documents that lead with the same shingle are compared first and joined where they link. Candidates are then pairs from
different components only, so that a large group of near copies gives no pairs, and each is verified by its whole sets.
Pairs are emitted for shingles of up to HOT documents. Rarer shingles stand first, so two documents that link and share
none of those in their prefixes have so few of them that hardly any documents are left; these are compared in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, dropped, mix, prepared, stored, table, words_of, written
from .graph import components

#: The first part of the order, as a multiple of what an l-prefix needs without l.
WIDTH = 2.0
#: Prefix lengths to choose from, by the matches that they ask for; all of the first part is one more choice.
MATCHES = (1, 2, 3, 4, 6, 8)
#: Documents of a shingle up to which their pairs are emitted.
HOT = 64
#: Documents that are compared in one block, and about how many shingles they have together.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Bits of the filter of document ids, at most: 2 MB.
FILTER_BITS = 1 << 24


def shingles(raws: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each text's distinct k-word shingles in the order of their hashes, where each text's begin and the end).

    Words are lower-cased (A to Z) runs without white space; a text of fewer than k words has one shingle of them all.
    """
    from .common import hash_spans

    buf, _, starts, ends, first = words_of(raws, lower=True)
    h = hash_spans(buf, starts, ends)
    counts = np.diff(first)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(raws)), n)
    at = np.repeat(first[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    size = np.minimum(k, np.repeat(counts, n))
    out = np.zeros(len(at), np.uint64)
    padded = np.concatenate([h, np.zeros(k, np.uint64)])
    for i in range(k):
        part = padded[at + i] * np.uint64(2 * i + 3) + np.uint64(i)
        out = np.where(i < size, mix(out * np.uint64(0x9E3779B97F4A7C15) + part), out)
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[new], np.searchsorted(owner[new], np.arange(len(raws) + 1))


def least_overlap(n: np.ndarray | int, percent: int):
    """The smallest overlap that a set of n needs with any set for a similarity of percent / 100: that of a subset of it."""
    return -(-percent * n // 100)


def _longs(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def lengths(h: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each set (hashes in order): its size, how many shingles are of the first part of the order, and how many are sent:
    those, and as many more as the longest prefix needs."""
    n = np.diff(at)
    low = np.concatenate([[0], np.cumsum(h < first_part(percent))])
    r = low[at[1:]] - low[at[:-1]]
    return n, r, np.maximum(r, np.minimum(n, n - least_overlap(n, percent) + MATCHES[-1]))


def first_part(percent: int) -> np.uint64:
    """Hashes below this are the first part of the order."""
    return np.uint64(min(1.0, WIDTH * (100 - percent) / 100) * (2**64 - 2**12))


def names(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each set."""
    c = np.zeros((2, len(at) - 1), np.uint64)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        c[0, some] = np.add.reduceat(h, at[:-1][some])
        c[1, some] = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), at[:-1][some])
    return _longs(c[0]), _longs(c[1])


def summaries(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n, r, c1, c2 of each row: its set's size, its shingles of the first part of the order, and its set's name."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n, r, c1, c2 = [], [], [], []
            for _, raws in batches(part.column("text").to_pylist()):
                h, at = shingles(raws, k)
                for out, x in zip((n, r), lengths(h, at, percent)[:2], strict=True):
                    out.append(x)
                for out, x in zip((c1, c2), names(h, at), strict=True):
                    out.append(x)
            columns = [pa.array(np.concatenate(x) if x else np.zeros(0), pa.int64()) for x in (n, r, c1, c2)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n", "r", "c1", "c2"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, r long, c1 long, c2 long")


def sent(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """token, c1: the shingles of each set that can be in its prefix; copies of a set within one task's part count once."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for part in parts:
            for _, raws in batches(part.column("text").to_pylist()):
                h, at = shingles(raws, k)
                e = lengths(h, at, percent)[2]
                c1, c2 = names(h, at)
                for i, name in enumerate(zip(c1.tolist(), c2.tolist(), strict=True)):
                    if name in seen:
                        e[i] = 0
                    seen.add(name)
                if len(seen) > 200_000:
                    seen.clear()
                token = np.repeat(at[:-1] - np.cumsum(e) + e, e) + np.arange(e.sum())
                for lo in range(0, len(token), 1 << 17):
                    s = slice(lo, lo + (1 << 17))
                    yield pa.RecordBatch.from_arrays([pa.array(_longs(h[token[s]])), pa.array(np.repeat(c1, e)[s])], ["token", "c1"])

    return docs.select("text").mapInArrow(run, "token long, c1 long")


def prefix(token: np.ndarray, count: np.ndarray, n: int, r: int, percent: int) -> tuple[np.ndarray, np.ndarray, int, bool]:
    """(the shingles of one set's prefix that other sets have too, which of them are hot, the prefix's length with the
    others, whether the set can link with one that shares none but hot ones).

    token: the shingles sent that others have, count: how many sets have each; n, r: the set's size and its shingles of the
    first part. With l matches the candidates are at most the sum of the other sets' places in the prefix divided by l;
    each costs about as much as 40 postings. A set with more than n - least shingles before the hot ones shares too few with
    a set that has none of those.
    """
    base = n - int(least_overlap(n, percent))
    h = token.view(np.uint64)
    early = h < first_part(percent)
    order = np.concatenate([np.flatnonzero(early)[np.lexsort((h[early], count[early]))], np.flatnonzero(~early)[np.argsort(h[~early])]])
    alone = r - int(early.sum())
    # (length, matches, places that others share): within the first part, or all that was sent.
    options = [(base + l, l, max(0, base + l - alone)) for l in {*MATCHES, r - base} if 1 <= l <= r - base]
    if r < min(n, base + MATCHES[-1]):
        length = min(n, base + MATCHES[-1])
        options.append((length, length - base, len(order)))
    sums = np.concatenate([[0], np.cumsum(count[order] - 1)])
    length, _, places = min(options, key=lambda o: (o[2] + 40.0 * sums[o[2]] / o[1], o[0]))
    order = order[:places]
    hot = count[order] > HOT
    return token[order], hot, length, length > r or length - int(hot.sum()) <= base


def postings(hits: DataFrame, percent: int) -> DataFrame:
    """token, rep, n, behind, lead, hot, hots, active: the prefixes of all sets. behind: shingles after the prefix; lead: the
    set's least token; hot, hots: whether the token is hot, and how many of the set are; active: as in `prefix`.

    hits: rep, n, r, and found (count, token): the shingles sent that other sets have too.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            chosen = [prefix(np.array([x["token"] for x in f], np.int64), np.array([x["count"] for x in f], np.int64), n, r, percent) for f, n, r in zip(frame["found"], frame["n"].tolist(), frame["r"].tolist(), strict=True)]
            size = np.array([len(c[0]) for c in chosen], np.int64)
            if not size.sum():
                continue
            lead = np.concatenate([t == t[np.argmin(t.view(np.uint64))] for t, *_ in chosen if len(t)])
            each = {"rep": frame["rep"].to_numpy(), "n": frame["n"].to_numpy(), "behind": frame["n"].to_numpy() - np.array([c[2] for c in chosen]), "hots": np.array([c[1].sum() for c in chosen]), "active": np.array([c[3] for c in chosen])}
            yield pd.DataFrame({"token": np.concatenate([c[0] for c in chosen]), "lead": lead, "hot": np.concatenate([c[1] for c in chosen])} | {k: np.repeat(v, size) for k, v in each.items()})

    return hits.mapInPandas(run, "token long, rep long, n long, behind long, lead boolean, hot boolean, hots long, active boolean")


def counted(classes: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """rep, n, r, found of the sets whose prefix reaches shingles of other sets: only these can link.

    Shingles are counted by partial sums first, and the join that gives the counts back can be split at a frequent one.
    """
    counts = tokens.groupBy("token").agg(F.count("*").alias("count")).filter("count > 1")
    hits = tokens.join(counts, "token").join(classes.filter("n > 0 and rep is not null").select("c1", "rep", "n", "r"), "c1")
    grouped = hits.groupBy("c1", "rep", "n", "r").agg(F.collect_set(F.struct("count", "token")).alias("found"))
    base = F.expr(f"n - ({percent} * n + 99) div 100")
    alone = F.col("r") - F.size(F.filter("found", lambda x: _early(x["token"], percent)))
    return grouped.filter(alone < base + 1).select("rep", "n", "r", "found")


def _early(token: Column, percent: int) -> Column:
    """Whether a shingle is of the first part of the order; hashes are read as signed numbers here."""
    end = int(first_part(percent))
    return (token >= 0) & (token < end) if end < 2**63 else (token >= 0) | (token < end - 2**64)


def dealt(groups: DataFrame, group: str) -> DataFrame:
    """doc_id, key: each group's documents in blocks of about BLOCK, of which each holds the group's first document too.

    groups: rep, n and the column group. Groups of one document are left out.
    """
    sizes = groups.groupBy(group).agg(F.count("*").alias("_count"), F.min("rep").alias("_pivot"), _blocks(1)).filter("_count > 1")
    name = lambda part: F.concat_ws("-", F.lit("b"), group, part)
    own = groups.join(sizes, group).select(F.col("rep").alias("doc_id"), name(F.pmod(F.xxhash64("rep"), F.col("_blocks"))).alias("key"))
    pivots = sizes.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).select(F.col("_pivot").alias("doc_id"), name(F.col("_part")).alias("key"))
    return own.union(pivots).distinct()


def _blocks(times: int) -> Column:
    """Into how many blocks documents are dealt of which each holds 1 / times of what is compared together."""
    return F.ceil(F.greatest(F.count("*") * times / BLOCK, F.sum("n") * times / BLOCK_SHINGLES)).cast("long").alias("_blocks")


def mixed(lists: DataFrame) -> DataFrame:
    """The rows of lists (token, comp and more) whose token is in more than one component: others can join no more."""
    several = lists.groupBy("token").agg(F.min("comp").alias("_least"), F.max("comp").alias("_most")).filter("_least < _most").select("token")
    return lists.join(several, "token", "left_semi")


def candidates(lists: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of documents of different components that share a shingle of at most HOT documents, and with all hot ones
    as many as they must.

    lists: token, rep, comp, n, behind, hots.
    """
    few = mixed(lists)
    x, y = (few.select("token", *[F.col(c).alias(f"{side}_{c}") for c in ("rep", "comp", "n", "behind", "hots")]) for side in "xy")
    both = x.join(y, "token").filter(f"x_rep < y_rep and x_comp <> y_comp and 100 * least(x_n, y_n) >= {percent} * greatest(x_n, y_n)")
    # An overlap of need at least; what lies behind the prefix that ends first can't be more than either has behind its own.
    need = F.expr(f"({percent} * (x_n + y_n) + {99 + percent}) div {100 + percent} - greatest(x_behind, y_behind) - least(x_hots, y_hots)")
    pairs = both.select(F.col("x_rep").alias("a"), F.col("y_rep").alias("b"), need.alias("need"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("need").alias("need")).filter("shared >= need").select("a", "b")


def compare(ids: np.ndarray, hashes: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """What the links among these sets connect, as pairs with the smallest: all overlaps by products of their incidence in columns."""
    m = len(ids)
    if m < 2:
        return []
    n = np.array([len(x) for x in hashes])
    token, column = np.unique(np.concatenate(hashes), return_inverse=True)
    often = np.bincount(column) > 1
    place = np.cumsum(often) - 1
    row = np.repeat(np.arange(m), n)[often[column]]
    column = place[column[often[column]]]
    overlap = np.zeros((m, m), np.float32)
    width = min(max(256, (1 << 22) // m), max(1, int(often.sum())))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, int(often.sum()), width):
        a, b = np.searchsorted(column, [lo, lo + width])
        part = np.zeros((m, width), np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        overlap += part @ part.T
    i, j = np.triu_indices(m, 1)
    o = overlap[i, j].astype(np.int64)
    linked = 100 * o >= percent * (n[i] + n[j] - o)
    parent = np.arange(m)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(i[linked].tolist(), j[linked].tolist(), strict=True):
        rx, ry = root(x), root(y)
        parent[max(rx, ry)] = min(rx, ry)
    # Each document with the smallest of those that it hangs together with here: stars, which need no more rounds.
    groups: dict[int, list[int]] = {}
    for x in np.flatnonzero(linked_any(i[linked], j[linked], m)):
        groups.setdefault(root(x), []).append(int(ids[x]))
    return [(min(g), x) for g in groups.values() for x in g if x != min(g)]


def linked_any(i: np.ndarray, j: np.ndarray, m: int) -> np.ndarray:
    """Whether each of m documents is in a link."""
    out = np.zeros(m, bool)
    out[i] = out[j] = True
    return out


def links(bundles: DataFrame, k: int, percent: int) -> DataFrame:
    """a, b: links that connect what the documents' links connect. bundles: key, role, doc_id, text.

    All documents of role 2 of a key, of which there are about BLOCK, are compared with one another; those of role 1 with the
    one of role 0 only, as they come.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, ids, hashes, middle = None, [], [], []
        for frame in frames:
            out, keys, roles, docs = [], frame["key"].tolist(), frame["role"].tolist(), frame["doc_id"].tolist()
            for lo, raws in batches(frame["text"].tolist()):
                h, at = shingles(raws, k)
                for i in range(len(raws)):
                    if keys[lo + i] != key:
                        out += compare(np.array(ids), hashes, percent)
                        key, ids, hashes, middle = keys[lo + i], [], [], []
                    own, role = h[at[i] : at[i + 1]].copy(), roles[lo + i]
                    if role == 0:
                        middle.append((docs[lo + i], own))
                    elif role == 1:
                        for other, theirs in middle:
                            o = len(np.intersect1d(own, theirs, assume_unique=True))
                            if 100 * o >= percent * (len(own) + len(theirs) - o):
                                out.append((other, docs[lo + i]))
                    else:
                        ids.append(docs[lo + i])
                        hashes.append(own)
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        yield pd.DataFrame(compare(np.array(ids), hashes, percent), columns=["a", "b"], dtype="int64")

    return bundles.repartition("key").sortWithinPartitions("key", "role").mapInPandas(run, "a long, b long")


def needed(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs joined to those of ids (doc_id and more), which is a table. A filter of a bounded number of bits first drops
    nearly all others where they are read, so that their texts aren't shuffled for the join."""
    bits = 1 << min(FILTER_BITS.bit_length() - 1, max(15, (16 * max(ids.count(), 1) - 1).bit_length()))
    place = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(bits)) + 1
    maps = ids.select(F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place).alias("_place")).groupBy("_bucket").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns({"_bucket": F.bitmap_bucket_number(place), "_place": F.bitmap_bit_position(place)})
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(_place div 8 as int) + 1, 1)")), 16, 10).cast("int")
    near = texts.join(F.broadcast(maps), "_bucket").filter((F.floor(byte / F.expr("shiftleft(1, cast(_place % 8 as int))")) % 2 == 1)).select("doc_id", "text")
    # Dealt once by doc_id, for dropping repeated rows and for the join.
    return near.repartition("doc_id").withColumn("_h", F.xxhash64("text")).dropDuplicates(["doc_id", "_h"]).drop("_h").join(ids, "doc_id")


def bundled(pairs: DataFrame, many: DataFrame) -> DataFrame:
    """doc_id, key, role: for each candidate pair a key that both have; a table that the caller drops.

    A pair goes by its first document, whose partners are dealt into parts of about BLOCK. Documents that hot shingles tie
    together (many: token, rep, n) are dealt into blocks, each two of which share a key.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("_parts"))
    stars = pairs.join(parts, "a").withColumn("key", F.concat_ws("-", F.lit("s"), "a", F.pmod(F.xxhash64("b"), F.col("_parts"))))
    stars = stars.select(F.col("b").alias("doc_id"), "key", F.lit(1).alias("role")).union(stars.select(F.col("a").alias("doc_id"), "key", F.lit(0)).distinct())
    firsts = many.groupBy("token").agg(F.min("rep").alias("a"))
    group = components(many.join(firsts, "token").select("a", F.col("rep").alias("b")))
    size = many.groupBy("rep").agg(F.max("n").alias("n"))
    hot = group.join(size, F.col("node") == F.col("rep")).select("component", "rep", "n")
    blocks = hot.groupBy("component").agg(_blocks(2))
    own = hot.join(blocks, "component").withColumn("_own", F.pmod(F.xxhash64("rep"), F.col("_blocks"))).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    # With more than one block, a block also meets itself within each of its pairs.
    own = own.filter("_blocks = 1 or _own <> _other")
    grid = own.select(F.col("rep").alias("doc_id"), F.concat_ws("-", F.lit("g"), "component", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("key"), F.lit(2))
    out = written(stars.union(grid))
    dropped(group)
    return out


def similar(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id that links lead to) of each row of docs (doc_id, text).

    Two documents link when their sets of distinct k-word shingles have a Jaccard similarity of percent / 100 or more;
    all links count, exactly, but for hashes of 64 bits. Sets alike are one from the start. Null and empty texts, and
    those without words, have no shingles and link with nothing. Rows of the same doc_id are rows of their own in the
    result and one document for links; a row without a doc_id gets the component of its copies, or null. An empty table
    gives no rows; other columns aren't kept.
    """
    prepared(docs.sparkSession)
    of_docs = stored(summaries(docs, k, percent))
    # Sets by the smallest document that has them.
    classes = stored(of_docs.filter("n > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("r").alias("r")))
    tokens = written(sent(docs, k, percent))
    lists = written(postings(counted(classes, tokens, percent), percent))
    dropped(tokens)

    keyed = written(dealt(lists.filter("lead").select("token", "rep", "n"), "token").withColumn("role", F.lit(2)))
    close = written(links(needed(docs, keyed).select("key", "role", "doc_id", "text"), k, percent))
    group = components(close)
    dropped(keyed, close)

    tagged = lists.join(group, lists["rep"] == group["node"], "left").withColumn("comp", F.coalesce("component", "rep"))
    pairs = written(candidates(tagged.filter("not hot"), percent))
    many = written(mixed(tagged.filter("hot and active")).select("token", "rep", "n"))
    bundles = bundled(pairs, many)
    dropped(lists, pairs, many)
    more = written(links(needed(docs, bundles).select("key", "role", "doc_id", "text"), k, percent))
    dropped(bundles)
    last = components(group.select(F.col("component").alias("a"), F.col("node").alias("b")).union(more))
    dropped(group, more)

    final = stored(classes.join(last, F.col("rep") == F.col("node"), "left").select("c1", "c2", F.coalesce("component", "rep").alias("component")))
    dropped(last)
    out = of_docs.join(final, ["c1", "c2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def op6_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"))


QUERIES = {"op6_near": op6_near}
ORACLES: dict[str, str] = {}
