"""Operator 7: toxic spans by a linear-chain conditional random field over tokens, gathered to document scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, hash_spans, held_out, joined, mix, prepared, runs_of, table
from .quality import fitted, sample

#: Weights; a hashed feature has one of so many.
SPACE = 1 << 18
#: Labelled rows to learn from at most: those of the least hash of their id.
SAMPLE = 3000
#: Tokens of a row that messages are passed along in step; a longer text is several rows, each of which takes its messages from
#: those beside it. Learning takes the rows as chains of their own.
CHAIN = 64
#: Bytes at a token's start that are features by themselves.
PREFIXES = (3, 4, 5, 6, 7)
_LETTER = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def folded(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in lower case (ASCII and the two-byte Latin letters, so that places stay), and where the texts start."""
    buf, at = joined(raws, lower=True)
    after = np.zeros(len(buf), bool)
    after[1:] = buf[:-1] == 0xC3
    buf = np.where(after & (buf >= 0x80) & (buf <= 0x9E) & (buf != 0x97), buf + 0x20, buf).astype(np.uint8)
    return buf, at


def tokens(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features of each token, start and end in its text's bytes, where each text's tokens begin and the end).

    Tokens are runs of letters and digits. Features are hashes of the token, of its first bytes, and of both neighbours.
    """
    buf, at = folded(raws)
    starts, ends = runs_of(_LETTER[buf])
    first = np.searchsorted(starts, at)
    own = hash_spans(buf, starts, ends)
    columns = [own]
    for n in PREFIXES:
        stop = np.minimum(starts + n, ends)
        columns.append(np.where(ends - starts >= n, mix(hash_spans(buf, starts, stop) + np.uint64(n)), np.uint64(0)))
    doc = np.searchsorted(at, starts, "right") - 1
    for shift, salt in ((1, 101), (-1, 103)):
        other = np.roll(own, shift)
        other[np.roll(doc, shift) != doc] = 0
        columns.append(mix(other + np.uint64(salt)))
    found = np.stack(columns, 1) if len(own) else np.zeros((0, len(PREFIXES) + 3), np.uint64)
    base = at[doc] if len(own) else np.zeros(0, np.int64)
    return (found % np.uint64(SPACE - 1) + np.uint64(1)).astype(np.int32) * (found != 0), starts - base, ends - base, first


def chains(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens as rows of at most CHAIN: (index of the token at each place of each row, whether there is one, the row's number in its text)."""
    counts = np.diff(first)
    n = -(-counts // CHAIN)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = np.repeat(first[:-1], n) + CHAIN * nth
    size = np.minimum(CHAIN, np.repeat(first[1:], n) - begin)
    steps = np.arange(CHAIN)
    on = steps < size[:, None]
    return np.where(on, begin[:, None] + steps, 0).astype(np.int32), on, nth


def marginals(emit: np.ndarray, on: np.ndarray, link: np.ndarray, nth: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over chains of two states, all at once.

    emit: (rows, places) score of being toxic; link: (2, 2) transition scores; nth: each row's number in its text, whose rows
    are one chain, or None if each row is one. Returns (the probability of being toxic at each place, the expected
    transitions within rows). Messages are ratios toxic to clean. What a row makes of a message is a product of 2 x 2
    matrices, so messages go from row to row first, and along all rows at once then.
    """
    length = emit.shape[1]
    w = np.exp(link)
    odds = np.exp(np.clip(emit, -30, 30))
    forward, backward = np.ones_like(odds), np.ones_like(odds)
    forward[:, 0] = odds[:, 0]
    after = np.ones(len(odds))
    if nth is not None and (nth > 0).any():
        before, after = _between(odds, on, w, nth)
        forward[:, 0] = np.where(nth > 0, odds[:, 0] * (w[0, 1] + before * w[1, 1]) / (w[0, 0] + before * w[1, 0]), odds[:, 0])
    for t in range(1, length):
        r = forward[:, t - 1]
        forward[:, t] = odds[:, t] * (w[0, 1] + r * w[1, 1]) / (w[0, 0] + r * w[1, 0])
    backward[:, -1] = after
    for t in range(length - 2, -1, -1):
        r = odds[:, t + 1] * backward[:, t + 1]
        backward[:, t] = np.where(on[:, t + 1], (w[1, 0] + w[1, 1] * r) / (w[0, 0] + w[0, 1] * r), after)
    both = forward * backward
    p = np.where(on, both / (1 + both), 0.0)
    pairs = on[:, 1:]
    left, right = forward[:, :-1], odds[:, 1:] * backward[:, 1:]
    joint = np.stack([np.ones_like(left) * w[0, 0], right * w[0, 1], left * w[1, 0], left * right * w[1, 1]])
    joint = (joint / joint.sum(0))[:, pairs].sum(1).reshape(2, 2)
    return p, joint


def _between(odds: np.ndarray, on: np.ndarray, w: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the ratio of the forward message that each row gets from the row before, of the backward one from the row after)."""
    n = len(odds)
    # (a b; c d): forward is the product of (w00 w10; o w01  o w11), or (1 0; 0 o) at a text's first token; backward that of (w00 o w01; w10 o w11).
    ahead, back = np.zeros((4, n)), np.zeros((4, n))
    ahead[[0, 3]] = back[[0, 3]] = 1
    for t in range(odds.shape[1]):
        o = odds[:, t]
        start = (nth == 0) & (t == 0)
        m = np.where(start, 1, w[0, 0]), np.where(start, 0, w[1, 0]), np.where(start, 0, o * w[0, 1]), np.where(start, o, o * w[1, 1])
        a, b, c, d = ahead
        new = np.stack([m[0] * a + m[1] * c, m[0] * b + m[1] * d, m[2] * a + m[3] * c, m[2] * b + m[3] * d])
        ahead = np.where(on[:, t], new / new.sum(0), ahead)
        a, b, c, d = back
        new = np.stack([a * w[0, 0] + b * w[1, 0], (a * w[0, 1] + b * w[1, 1]) * o, c * w[0, 0] + d * w[1, 0], (c * w[0, 1] + d * w[1, 1]) * o])
        back = np.where(on[:, t], new / new.sum(0), back)
    before, after = np.ones(n), np.ones(n)
    place = np.argsort(nth, kind="stable")
    bounds = np.searchsorted(nth[place], np.arange(nth.max() + 2))
    for k in range(1, nth.max() + 1):
        i = place[bounds[k] : bounds[k + 1]] - 1
        before[i + 1] = (ahead[2, i] + ahead[3, i] * before[i]) / (ahead[0, i] + ahead[1, i] * before[i])
    for k in range(nth.max(), 0, -1):
        i = place[bounds[k] : bounds[k + 1]]
        after[i - 1] = (back[2, i] + back[3, i] * after[i]) / (back[0, i] + back[1, i] * after[i])
    return before, after


def label_tokens(found: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Labels of tokens from labels of documents: a token of a toxic document is toxic if one of its own features is
    found in toxic documents nearly alone, by counts of documents."""
    doc = np.repeat(np.arange(len(toxic)), np.diff(first))
    inside, outside = np.zeros(SPACE), np.zeros(SPACE)
    for column in range(1 + len(PREFIXES)):
        flat = np.unique(doc * SPACE + found[:, column])
        d, f = flat // SPACE, flat % SPACE
        inside += np.bincount(f[toxic[d] == 1], minlength=SPACE)
        outside += np.bincount(f[toxic[d] == 0], minlength=SPACE)
    share = toxic.mean() if len(toxic) else 0.5
    # At least three documents, and odds 30 times those of a document drawn at random.
    sure = (inside >= 3) & ((inside + 0.1) / (outside + 0.1) >= 30 * share / max(1 - share, 1e-9))
    sure[0] = False
    marked = np.zeros(len(found), bool)
    for column in range(1 + len(PREFIXES)):
        marked |= sure[found[:, column]]
    return (marked & (toxic[doc] == 1)).astype(np.float64)


def summary(p: np.ndarray, index: np.ndarray, on: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each token's marginal, features of each document: the logit of its greatest marginal, log of 1 + their sum)."""
    each = np.zeros(first[-1])
    each[index[on]] = p[on]
    sums, most = np.zeros(len(first) - 1), np.zeros(len(first) - 1)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        sums[some] = np.add.reduceat(each, first[:-1][some])
        most[some] = np.maximum.reduceat(each, first[:-1][some])
    most = np.clip(most, 1e-6, 1 - 1e-6)
    return each, np.stack([np.log(most / (1 - most)), np.log1p(sums)], 1)


def train(texts: list[str | None], toxic: list[int], epochs: int = 12, rate: float = 0.3, decay: float = 1e-6) -> dict[str, np.ndarray]:
    """The field's weights by stochastic gradients of its likelihood (steps scaled for each weight), then the two weights
    and the constant that turn marginals into a document's score, by Newton steps."""
    parts, firsts, total = [], [np.zeros(1, np.int64)], 0
    for _, raws in batches(texts):
        found, _, _, first = tokens(raws)
        parts.append(found)
        firsts.append(first[1:] + total)
        total += len(found)
    toxic = np.asarray(toxic, np.int64)
    model = {"weights": np.zeros(SPACE), "link": np.zeros((2, 2)), "document": np.array([0.0, 0.0, 0.0])}
    if not len(toxic):
        return model
    found, first = np.concatenate(parts), np.concatenate(firsts)
    truth = label_tokens(found, first, toxic)
    index, on, nth = chains(first)
    # Chains with toxic tokens all count; of the others as many as ten times those, evenly, as they are nearly all alike.
    marked = (truth[index] * on).any(1)
    clean = np.flatnonzero(~marked)
    keep = np.concatenate([np.flatnonzero(marked), clean[:: max(1, len(clean) // max(2000, 10 * marked.sum()))]])
    draw = np.random.default_rng(7)
    w, gw = model["weights"], np.full(SPACE, 1e-3)
    link, gl = model["link"], np.full((2, 2), 1e-3)
    w0, g0 = np.array(-3.0), 1e-3
    for _ in range(epochs):
        for rows in np.array_split(draw.permutation(keep), max(1, len(keep) // 256)):
            i, m = index[rows], on[rows]
            p, pairs = marginals(np.where(m, w[found[i]].sum(2) + w0, 0.0), m, link)
            y = truth[i]
            error = np.where(m, p - y, 0.0)
            g = np.zeros(SPACE)
            np.add.at(g, found[i][m].ravel(), np.repeat(error[m], found.shape[1]))
            g = g / len(rows) + decay * w
            g[0] = 0
            gw += g * g
            w -= rate * g / np.sqrt(gw)
            real = np.stack([((1 - y[:, :-1]) * (1 - y[:, 1:]))[m[:, 1:]].sum(), ((1 - y[:, :-1]) * y[:, 1:])[m[:, 1:]].sum(), (y[:, :-1] * (1 - y[:, 1:]))[m[:, 1:]].sum(), (y[:, :-1] * y[:, 1:])[m[:, 1:]].sum()]).reshape(2, 2)
            gk = (pairs - real) / len(rows)
            gl += gk * gk
            link -= rate * gk / np.sqrt(gl)
            gb = error.sum() / len(rows)
            g0 += gb * gb
            w0 -= rate * gb / np.sqrt(g0)
    model["weights"], model["link"], model["constant"] = w.astype(np.float32), link, np.asarray(w0)
    # Pieces of whole texts.
    starts = np.append(np.flatnonzero(nth == 0), len(nth))
    cuts = np.unique(np.append(starts[np.searchsorted(starts, np.arange(0, len(nth), 2000))], len(nth)))
    each = []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        i, m = index[lo:hi], on[lo:hi]
        each.append(marginals(np.where(m, w[found[i]].sum(2) + w0, 0.0), m, link, nth[lo:hi])[0])
    _, x = summary(np.concatenate(each) if each else np.zeros((0, CHAIN)), index, on, first)
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    v = np.array([0.0, 0.0, np.log((toxic.mean() + 1e-3) / (1 - toxic.mean() + 1e-3))])
    for _ in range(25):
        q = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        hess = (x * (q * (1 - q))[:, None]).T @ x + np.diag([0.05, 0.05, 0.05])
        v -= np.linalg.solve(hess, x.T @ (q - toxic) + 0.05 * v)
    model["document"] = v
    return model


def apply(model: dict[str, np.ndarray], raws: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """(the score of each text, its toxic spans as (start, end, probability) in bytes)."""
    found, starts, ends, first = tokens(raws)
    index, on, nth = chains(first)
    emit = model["weights"][found].sum(1) + model.get("constant", 0.0)
    p, _ = marginals(np.where(on, emit[index], 0.0) if len(emit) else np.zeros(on.shape), on, model["link"], nth)
    each, x = summary(p, index, on, first)
    v = model["document"]
    score = 1 / (1 + np.exp(-np.clip(x @ v[:2] + v[2], -30, 30)))
    spans: list[list[tuple[int, int, float]]] = [[] for _ in raws]
    hits = np.flatnonzero(each >= 0.5)
    for k, doc in zip(hits, np.searchsorted(first, hits, "right") - 1, strict=True):
        spans[doc].append((int(starts[k]), int(ends[k]), float(each[k])))
    return score, spans


def score(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted and spans (start and stop in characters, probability) of each row of docs.

    The field learns from at most `rows` labelled rows. A document's score comes from the greatest and the summed marginal
    of its tokens; spans are the tokens more likely toxic than not. Texts without tokens, null ones included, have only
    the document's constant. With no labelled rows all score 0.5. Whole texts are read; repeated rows score alike; an empty
    table gives no rows; other columns aren't kept.
    """
    prepared(docs.sparkSession)
    model = fitted(sample(docs, labels, "toxic", rows), "label", train)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out, spans = [], []
            for _, raws in batches(frame["text"].tolist()):
                s, found = apply(model.value, raws)
                out.append(s)
                for raw, marks in zip(raws, found, strict=True):
                    # Characters before each byte.
                    place = np.cumsum(np.frombuffer(b"x" + raw, np.uint8) & 0xC0 != 0x80) - 1 if marks else []
                    spans.append([{"start": int(place[a]), "stop": int(place[b]), "probability": p} for a, b, p in marks])
            s = np.concatenate(out) if out else np.zeros(0)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": s, "predicted": (s >= 0.5).astype(np.int32), "spans": spans})

    found = docs.select("doc_id", "text").mapInPandas(run, "doc_id long, score double, predicted int, spans array<struct<start:int,stop:int,probability:double>>")
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted", "spans")


def clean(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """The rows of docs (doc_id, text and more) that don't score as toxic, as they are; each row is judged where it is read, and none moves."""
    prepared(docs.sparkSession)
    model = fitted(sample(docs, labels, "toxic", rows), "label", train)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            scores = [apply(model.value, raws)[0] for _, raws in batches(part.column("text").to_pylist())]
            yield part.filter(pa.array(np.concatenate(scores) < 0.5)) if scores else part

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_spans"))


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLES: dict[str, str] = {}
