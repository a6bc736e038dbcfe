"""Operator 8: a quality classifier over hashed word n-grams, learned by follow-the-regularised-leader updates."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _SPACE, batches, hash_spans, held_out, joined, mix, prepared, table

#: Weights; a hashed n-gram has one of so many.
SPACE = 1 << 18
#: Labelled rows to learn from at most: those of the least hash of their id.
SAMPLE = 4000
#: Bytes of a text to learn from at most, so that a sample is bounded in bytes too; longer texts are scored, not learned from.
LONGEST = 1 << 16
_ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def features(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-grams of all texts, where each text's begin and the end).

    Tokens are runs of letters and digits, or of other signs that aren't white space. N-grams are tokens, pairs of
    neighbours, and one n-gram that stands for any token followed by itself.
    """
    buf, at = joined(raws)
    kind = np.where(_SPACE[buf], 0, np.where(_ALNUM[buf], 1, 2)).astype(np.int8)
    cut = np.flatnonzero(np.diff(kind, prepend=np.int8(0)))
    ends = np.append(cut[1:], len(buf))
    keep = kind[cut] > 0
    starts, ends = cut[keep], ends[keep]
    h = hash_spans(buf, starts, ends)
    n = len(h)
    doc = np.searchsorted(at, starts, "right") - 1
    one = h
    same_doc = doc[1:] == doc[:-1]
    pair = mix(h[:-1] * np.uint64(3) + h[1:])
    pair[h[:-1] == h[1:]] = 7
    out = np.concatenate([one, pair[same_doc]])
    of = np.concatenate([doc, doc[1:][same_doc]]) if n else np.zeros(0, np.int64)
    order = np.argsort(of, kind="stable")
    return (out[order] % np.uint64(SPACE)).astype(np.int32), np.searchsorted(of[order], np.arange(len(raws) + 1))


def vector(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's n-grams as a sparse vector of length 1: root of the counts."""
    index, count = np.unique(grams, return_counts=True)
    return index, (np.sqrt(count) / np.sqrt(max(len(grams), 1))).astype(np.float32)


def learn(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> np.ndarray:
    """FTRL-proximal weights; the last one is the constant's. Rows come in the same order each time."""
    z, n = np.zeros(SPACE + 1), np.zeros(SPACE + 1)
    order = np.random.default_rng(5)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    rows = [(np.append(i, SPACE), np.append(x, 1.0)) for i, x in rows]
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            i, x = rows[k]
            w = weights(z[i], n[i])
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - labels[k]) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(z, n).astype(np.float32)


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE) -> DataFrame:
    """doc_id, text and label of at most `rows` labelled documents, by the hash of their ids, whose texts have at most LONGEST
    bytes. A document labelled twice counts once, by its greater label; of several rows of one id, the text of least hash counts.
    Labels of documents that aren't there, or are longer, take no place in the sample."""
    short = docs.select("doc_id", "text").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST)
    ids = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), 5, 0)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    ids = ids.join(short.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most `rows` pairs of numbers.
    found = short.join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("label").alias("label"))


def fitted(known: DataFrame, target: str, fit: Callable[[list, list], object]) -> Broadcast:
    """fit(texts, targets) over a bounded sample, in one task of the cluster, so that the driver holds the model only."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [f for f in frames if len(f)]
        all_ = pd.concat(parts).sort_values("doc_id", ignore_index=True) if parts else pd.DataFrame({"text": [], target: []})
        yield pd.DataFrame({"model": [pickle.dumps(fit(all_["text"].tolist(), all_[target].tolist()))]})

    row = known.repartition(1).mapInPandas(run, "model binary").first()
    return known.sparkSession.sparkContext.broadcast(pickle.loads(row["model"]) if row else fit([], []))


def train(texts: list[str | None], labels: list[int]) -> np.ndarray:
    rows = []
    for _, raws in batches(texts):
        grams, at = features(raws)
        rows += [vector(grams[at[i] : at[i + 1]]) for i in range(len(raws))]
    return learn(rows, np.asarray(labels, float))


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, rows: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs (doc_id, text).

    A score is the sparse dot product of the text's n-grams with weights learned from at most `rows` labelled rows, as a
    probability. Null and empty texts have no n-grams and so get the constant's. With no labelled rows all score 0.5.
    Whole texts are read; repeated rows score alike; an empty table gives no rows; other columns aren't kept.
    """
    prepared(docs.sparkSession)
    weights = fitted(sample(docs, labels, label, rows), "label", train)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = weights.value
        for frame in frames:
            out = np.empty(len(frame))
            for first, raws in batches(frame["text"].tolist()):
                grams, at = features(raws)
                for i in range(len(raws)):
                    index, x = vector(grams[at[i] : at[i + 1]])
                    out[first + i] = w[index] @ x + w[-1]
            p = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": p, "predicted": (p >= threshold).astype(np.int32)})

    scored = docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op8_quality": op8_quality}
ORACLES: dict[str, str] = {}
