"""Operator 4: exact top-k by inner product over a pivot-distance index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import prepared, stored, table

#: Rows that pivots are chosen from (those of the least hash of their id), pivots, vectors in a block of the index, queries in a
#: group, keys that the blocks of one pivot are dealt to.
SAMPLE, PIVOTS, BLOCK, QUERIES_IN_GROUP, SALTS = 4000, 32, 1024, 256, 8
#: Blocks that a group of queries visits in its first turn, and how many times more in each further one.
FIRST, GROWTH = 8, 8
NONE = np.iinfo(np.int64).min


def whole_numbers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and x: the components times `scale`, rounded down; rows that are null or hold null or non-finite components go."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    ok = F.col("embedding").isNotNull() & F.forall("embedding", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return vectors.filter(ok).select("vec_id", F.transform(x, lambda v: F.floor(v * scale).cast("double")).alias("x"))


def choose_pivots(x: np.ndarray, count: int) -> np.ndarray:
    """Rows far from each other: each is the one farthest from those before it."""
    if not len(x):
        return x
    chosen = [0]
    far = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """With one component more, that makes all vectors as long as the longest: then nearer means a greater inner product."""
    return np.concatenate([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]], 1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole-number inner products: floating point holds them exactly below 2**53, Python's numbers beyond."""
    bound = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(q.shape[1], 1)
    if bound < 2**53:
        return (q @ x.T).astype(np.int64)
    big = lambda m: np.array([[int(v) for v in row] for row in m], object)
    return big(q).dot(big(x).T).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, own: np.ndarray, k: int, least: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row of the query, id, score): for each query at most k rows other than itself with a score of at least `least`, ties to smaller ids."""
    for i in range(len(scores)):
        row = scores[i]
        hits = np.flatnonzero((row >= least[i]) & (rows != own[i]))
        if len(hits) > k:
            cut = np.partition(row[hits], len(hits) - k)[len(hits) - k]
            hits = hits[row[hits] >= cut]
            hits = hits[np.lexsort((ids[hits], -row[hits]))][:k]
        for j in hits:
            yield int(own[i]), int(ids[j]), int(row[j])


def top_k(vectors: DataFrame, k: int = 5, is_query=None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k greatest inner products with all rows but itself, ties to smaller vec_id.

    vectors: vec_id, embedding. The index keys each vector by its nearest pivot and its distance to it (annuli of that
    distance, large ones dealt into blocks of bounded size). Queries of one block form groups. A group first meets the block
    it lies in, which gives each query a score that its k-th best reaches at least. Then it visits the blocks that the triangle
    inequality lets come near enough, those of the least bound first, in turns of growing size: after each turn the k-th scores
    found tighten the bounds, and a group ends when no block left comes within them. The sample only sets where pivots lie:
    every row is indexed, and results are exact.

    Rows that are null, or hold null or non-finite components, take no part. Shorter vectors count as 0 beyond their end.
    Repeated vec_ids are rows of their own, as candidates and as queries: each has its own ranking, in which the others may
    stand. Fewer candidates than k give fewer rows; an empty table none; other columns aren't kept. Products are exact whole
    numbers.
    """
    spark = prepared(vectors.sparkSession)
    is_query = is_query if is_query is not None else F.col("vec_id") % 50 == 0
    rows = whole_numbers(vectors)
    size = rows.agg(F.max(F.size("x")).alias("d"), F.max(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)).alias("top")).first()
    if not size["d"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    d, top = size["d"], size["top"]
    rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0.0), d - F.size("x"))))
    pivots = lifted(choose_pivots(_matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()["x"]), PIVOTS), top)
    width = max(float(np.sqrt(top)) / 64, 1e-9)
    # Slack covers rounding of the distances; it only lets more blocks in.
    slack = 1e-6 * (1 + float(np.sqrt(top)))

    def to_pivots(x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(((x[:, None] - pivots) ** 2).sum(2), 0))

    def key(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            x = lifted(_matrix(frame["x"]), top)
            far = to_pivots(x)
            near = far.argmin(1)
            r = far[np.arange(len(x)), near]
            yield pd.DataFrame({"vec_id": frame["vec_id"], "pivot": near.astype(np.int32), "r": r, "ring": (r / width).astype(np.int64), "raw": [v[:-1].tobytes() for v in x], "query": frame["query"]})

    keyed = stored(rows.withColumn("query", is_query).mapInPandas(key, "vec_id long, pivot int, r double, ring long, raw binary, query boolean").withColumn("row", F.monotonically_increasing_id()))
    # Blocks of bounded size: a crowded annulus is dealt by hash into as many as it needs. There are at most some 200 annuli a pivot.
    counts = keyed.groupBy("pivot", "ring").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = keyed.join(F.broadcast(counts), ["pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    blocks = stored(dealt.groupBy("pivot", "ring", "part").agg(
        F.sort_array(F.collect_list(F.struct("vec_id", "row", "raw", "query"))).alias("rows"), F.min("r").alias("r_min"), F.max("r").alias("r_max"))
        .withColumn("block", F.monotonically_increasing_id()))

    def unpack(items) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        x = np.frombuffer(b"".join(bytes(v["raw"]) for v in items)).reshape(len(items), d)
        return np.array([v["vec_id"] for v in items], np.int64), np.array([v["row"] for v in items], np.int64), x, np.array([bool(v["query"]) for v in items])

    def reached(q: np.ndarray, least: np.ndarray) -> np.ndarray:
        """How far a row that scores at least `least` can be from each query."""
        far = np.sqrt(np.maximum((q * q).sum(1) + top - 2.0 * least.astype(np.float64), 0))
        return np.where(least == NONE, np.inf, far)

    def at_home(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each block's queries in groups, with the k-th score they reach in the block."""
        for frame in frames:
            for block, items in zip(frame["block"], frame["rows"], strict=True):
                ids, places, x, asks = unpack(items)
                for lo in range(0, int(asks.sum()), QUERIES_IN_GROUP):
                    own, q = places[asks][lo : lo + QUERIES_IN_GROUP], x[asks][lo : lo + QUERIES_IN_GROUP]
                    scores = np.where(places == own[:, None], NONE, _scores(q, x))
                    least = np.sort(scores, 1)[:, -k] if len(ids) >= k else np.full(len(q), NONE)
                    wide = lifted(q, top)
                    wide[:, -1] = 0  # a query needs no length of its own
                    far, reach = to_pivots(wide), reached(q, least)[:, None]
                    yield pd.DataFrame({"asked": [f"{block}-{lo}"], "ids": [ids[asks][lo : lo + QUERIES_IN_GROUP].tobytes()], "own": [own.tobytes()], "q": [q.tobytes()], "least": [least.tobytes()], "far": [far.tobytes()], "near": [far.min(0).tolist()], "wide": [far.max(0).tolist()], "from": [(far - reach).min(0).tolist()], "to": [(far + reach).max(0).tolist()]})

    group = "asked string, ids binary, own binary, q binary, least binary, far binary, near array<double>, wide array<double>, `from` array<double>, to array<double>"
    asked = stored(blocks.select("block", "rows").mapInPandas(at_home, group))

    # The blocks of each group, by the least distance from any of its queries' spheres to their annulus.
    spans = asked.select("asked", F.posexplode(F.arrays_zip("from", "to", "near", "wide")).alias("pivot", "span")).select("asked", "pivot", "span.*").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rings = blocks.select("block", "pivot", "r_min", "r_max", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int").alias("salt"))
    within = (F.col("r_max") >= F.col("from") - slack) & (F.col("r_min") <= F.col("to") + slack)
    gap = F.greatest(F.lit(0.0), F.col("near") - F.col("r_max"), F.col("r_min") - F.col("wide"))
    turn = F.row_number().over(Window.partitionBy("asked").orderBy(gap, "block"))
    visits = stored(spans.join(rings, ["pivot", "salt"]).filter(within).withColumn("turn", turn).select("asked", "block", "pivot", "r_min", "r_max", "turn"))
    last = visits.agg(F.max("turn")).first()[0] or 0

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list[tuple] = []
            for w in frame.itertuples():
                least, asks, own = np.frombuffer(w.least, np.int64), np.frombuffer(w.ids, np.int64), np.frombuffer(w.own, np.int64)
                q, far = np.frombuffer(w.q).reshape(len(own), d), np.frombuffer(w.far).reshape(len(own), -1)[:, w.pivot]
                reach = reached(q, least)
                near = (far - reach <= w.r_max + slack) & (far + reach >= w.r_min - slack)
                if not near.any():
                    continue
                ids, places, x, _ = unpack(w.rows)
                name = dict(zip(own.tolist(), asks.tolist(), strict=True))
                out += [(w.asked, row, name[row], i, s) for row, i, s in best(_scores(q[near], x), ids, places, own[near], k, least[near])]
            yield pd.DataFrame(out, columns=["asked", "own", "query_id", "vec_id", "score"])

    def tighten(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups with the k-th scores found, where they are greater than those known."""
        for frame in frames:
            for i, w in enumerate(frame.itertuples()):
                own, q = np.frombuffer(w.own, np.int64), np.frombuffer(w.q).reshape(-1, d)
                far, found = np.frombuffer(w.far).reshape(len(own), -1), {v["own"]: v["kth"] for v in (w.found if w.found is not None else ())}
                least = np.maximum(np.frombuffer(w.least, np.int64), np.array([found.get(o, NONE) for o in own.tolist()], np.int64))
                reach = reached(q, least)[:, None]
                row = frame.iloc[[i]].drop(columns="found")
                yield row.assign(least=[least.tobytes()], **{"from": [(far - reach).min(0).tolist()], "to": [(far + reach).max(0).tolist()]})

    hits = None
    order = Window.partitionBy("own").orderBy(F.desc("score"), "vec_id")
    done, size = 0, FIRST
    while done < last:
        due = visits.filter(F.col("turn").between(done + 1, done + size)).join(asked, "asked")
        due = due.filter((F.col("r_max") >= F.col("from")[F.col("pivot")] - slack) & (F.col("r_min") <= F.col("to")[F.col("pivot")] + slack)).drop("near", "wide", "from", "to")
        found = due.join(blocks.select("block", "rows"), "block").mapInPandas(search, "asked string, own long, query_id long, vec_id long, score long")
        # Blocks send only what reaches the bounds: a query has a few rows from each block that it met.
        both = found if hits is None else hits.drop("rank").unionByName(found)
        hits = stored(both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))
        done, size = done + size, size * GROWTH
        if done < last:
            kth = hits.filter(F.col("rank") == k).groupBy("asked").agg(F.collect_list(F.struct("own", F.col("score").alias("kth"))).alias("found"))
            asked = stored(asked.join(kth, "asked", "left").mapInPandas(tighten, group))
    if hits is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return hits.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


QUERIES = {"op4_topk": op4_topk}
ORACLES = {
    "op4_topk": """
with v as (
  select row_number() over () as place, vec_id, list_transform(embedding, lambda e: cast(floor(256 * cast(e as double)) as bigint)) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0
), s as (
  select q.place, q.vec_id as query_id, c.vec_id, cast(coalesce(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])), 0) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and c.place <> q.place
), r as (
  select query_id, cast(row_number() over (partition by place order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""
}
