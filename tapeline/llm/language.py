"""Operator 5: language identification by a bidirectional gated recurrent network over bytes, written in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, held_out, prepared, table
from .quality import LONGEST, fitted

#: Labelled rows to learn from at most: those of the least hash of their id.
SAMPLE = 2400
#: Units in each direction, bytes that are read in one go, and windows that are read side by side.
UNITS, WINDOW, ABREAST = 8, 96, 2048
_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


def new(classes: list[str], seed: int = 11) -> dict:
    """Small random weights. x: byte to gate inputs (reset, update, candidate); u: state to gates; v: states to classes."""
    draw = np.random.default_rng(seed)
    scale = lambda *shape: (draw.standard_normal(shape) * 0.3).astype(np.float32)
    net = {f"{name}{way}": w for way in "fb" for name, w in (("x", scale(3 * UNITS, 256)), ("u", scale(3 * UNITS, UNITS)), ("c", np.zeros((UNITS, 1), np.float32)))}
    return net | {"v": scale(len(classes), 2 * UNITS), "k": np.zeros((len(classes), 1), np.float32), "classes": classes}


def _sigmoid(a: np.ndarray) -> np.ndarray:
    a *= np.float32(0.5)
    np.tanh(a, out=a)
    a += np.float32(1)
    a *= np.float32(0.5)
    return a


def states(x: np.ndarray, wx: np.ndarray, u: np.ndarray, c: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """The state after each byte of x (places, windows), units first; with keep, also what the way back needs."""
    n = UNITS
    h = np.zeros((n, x.shape[1]), np.float32)
    out, kept = np.empty((len(x), n, x.shape[1]), np.float32), []
    g = np.empty((3 * n, x.shape[1]), np.float32)
    for t in range(len(x)):
        np.take(wx, x[t], axis=1, out=g, mode="clip")
        a = u @ h
        g[: 2 * n] += a[: 2 * n]
        rz = _sigmoid(g[: 2 * n])
        inner = a[2 * n :] + c
        new_h = np.tanh(g[2 * n :] + rz[:n] * inner)
        if keep:
            kept.append((h, rz.copy(), inner, new_h))
        h = new_h + rz[n:] * (h - new_h)
        out[t] = h
    return out, kept


def back(x: np.ndarray, kept: list, dout: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of x's table, of u and of c, by going back through time."""
    n = UNITS
    du, dc, dh = np.zeros_like(u), np.zeros((n, 1), np.float32), np.zeros_like(dout[0])
    dg = np.empty((len(x), 3 * n, x.shape[1]), np.float32)
    for t in range(len(x) - 1, -1, -1):
        h, rz, inner, cand = kept[t]
        dh = dh + dout[t]
        r, z = rz[:n], rz[n:]
        da = dh * (1 - z) * (1 - cand * cand)
        dz = dh * (h - cand) * z * (1 - z)
        dr = da * inner * r * (1 - r)
        dinner = da * r
        dg[t, :n], dg[t, n : 2 * n], dg[t, 2 * n :] = dr, dz, da
        gates = np.concatenate([dr, dz, dinner])
        du += gates @ h.T
        dc += dinner.sum(1, keepdims=True)
        dh = dh * z + u.T @ gates
    flat = np.ascontiguousarray(dg.transpose(1, 0, 2)).reshape(3 * n, -1)
    places = x.reshape(-1)
    return np.stack([np.bincount(places, row, 256) for row in flat]).astype(np.float32), du, dc


def windows(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes in lower case as (windows, WINDOW), bytes there are in each, the text of each). Texts are covered whole."""
    sizes = np.array([len(r) for r in raws], np.int64)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(raws)), counts)
    data = np.zeros((counts.sum(), WINDOW), np.uint8)
    flat = data.reshape(-1)
    for raw, first in zip(raws, np.cumsum(counts) - counts, strict=True):
        flat[first * WINDOW : first * WINDOW + len(raw)] = np.frombuffer(raw, np.uint8)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return data, np.minimum(WINDOW, sizes[owner] - nth * WINDOW), owner


def learn(texts: list[str], langs: list[str], steps: int = 320, batch: int = 256, rate: float = 0.02) -> dict:
    """Weights from windows spread over whole texts, all positions of a window labelled by its text's language."""
    classes = sorted(set(langs))
    net = new(classes)
    draw = np.random.default_rng(3)
    data, sizes, owner = windows([t.lower().encode() for t in texts])
    full = np.flatnonzero(sizes >= min(WINDOW, 8))
    if len(classes) < 2 or not len(full):
        return net
    label = np.array([classes.index(x) for x in langs])[owner]
    shares = np.bincount(label[full], minlength=len(classes))
    chance = 1 / np.sqrt(shares[label[full]])
    chance /= chance.sum()
    names = [k for k in net if k != "classes"]
    moment = {k: [np.zeros_like(net[k]), np.zeros_like(net[k])] for k in names}
    for step in range(steps):
        rows = draw.choice(full, batch, p=chance)
        x, y, m = data[rows].T, label[rows], (np.arange(WINDOW)[:, None] < sizes[rows])
        hf, kf = states(x, net["xf"], net["uf"], net["cf"], True)
        hb, kb = states(x[::-1], net["xb"], net["ub"], net["cb"], True)
        both = np.concatenate([hf, hb[::-1]], 1)
        logits = net["v"] @ both + net["k"]
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[:, y, np.arange(batch)] -= 1
        p *= (m / m.sum())[:, None, :].astype(np.float32)
        grads = {"v": np.einsum("tkb,thb->kh", p, both), "k": p.sum((0, 2))[:, None]}
        dboth = net["v"].T @ p
        grads["xf"], grads["uf"], grads["cf"] = back(x, kf, dboth[:, :UNITS], net["uf"])
        grads["xb"], grads["ub"], grads["cb"] = back(x[::-1], kb, dboth[::-1, UNITS:], net["ub"])
        speed = rate * min(1, 3 * (1 - step / steps)) * np.sqrt(1 - 0.99 ** (step + 1)) / (1 - 0.9 ** (step + 1))
        for k in names:
            g = np.clip(grads[k], -0.1, 0.1)
            moment[k][0] += 0.1 * (g - moment[k][0])
            moment[k][1] += 0.01 * (g * g - moment[k][1])
            net[k] = (net[k] - speed * moment[k][0] / (np.sqrt(moment[k][1]) + 1e-6)).astype(np.float32)
    return net


def position_sums(net: dict, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(windows, classes): each window's class probabilities, summed over its letters."""
    out = np.empty((len(data), len(net["classes"])), np.float32)
    for lo in range(0, len(data), ABREAST):
        x = np.ascontiguousarray(data[lo : lo + ABREAST].T)
        size = sizes[lo : lo + ABREAST]
        use = (_LETTER[x] & (np.arange(WINDOW)[:, None] < size)).astype(np.float32)
        hf, _ = states(x, net["xf"], net["uf"], net["cf"])
        hb, _ = states(x[::-1], net["xb"], net["ub"], net["cb"])
        total = np.zeros((len(net["classes"]), x.shape[1]), np.float32)
        vf, vb = np.ascontiguousarray(net["v"][:, :UNITS]), np.ascontiguousarray(net["v"][:, UNITS:])
        for t in range(WINDOW):
            e = vf @ hf[t]
            e += vb @ hb[WINDOW - 1 - t]
            e += net["k"]
            np.exp(e, out=e)
            e *= use[t] / e.sum(0)
            total += e
        out[lo : lo + ABREAST] = total.T
    return out


def predict(net: dict, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """(language, probability) of each text."""
    langs: list[str] = []
    scores = []
    for first, raws in batches([t.lower() if t else t for t in texts], 1 << 19):
        data, sizes, owner = windows(raws)
        sums = np.zeros((len(raws), len(net["classes"])))
        np.add.at(sums, owner, position_sums(net, data, sizes))
        total = sums.sum(1)
        for i in range(len(raws)):
            text = texts[first + i]
            if not net["classes"] or not text or not any(map(str.isalpha, text)):
                langs.append("und")
                scores.append(0.0)
                continue
            best = int(sums[i].argmax())
            langs.append(net["classes"][best])
            scores.append(float(sums[i, best] / total[i]) if total[i] else 1 / len(net["classes"]))
    return langs, np.clip(np.array(scores), 0, 1)


def identify(docs: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of docs (doc_id, text, lang).

    The network reads windows of whole texts in both directions, labels every position, and a document's probabilities
    are the mean over its letters. It learns from at most `rows` documents that have a language and aren't held
    out, one row of each, whose texts have at most LONGEST bytes.
    Null texts and those without a letter are `und` with score 0; so are all when there's nothing to learn from. Repeated
    rows get the same; an empty table gives no rows; other columns aren't kept.
    """
    prepared(docs.sparkSession)
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (F.octet_length("text") <= LONGEST) & ~held_out(F.col("doc_id"), 4, 2)).select("doc_id", "text", "lang")
    ids = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    own = F.struct("text", "lang")
    some = known.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min_by(own, F.xxhash64("text", "lang")).alias("own"))
    net = fitted(some.select("doc_id", "own.text", "own.lang"), "lang", learn)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            langs, scores = predict(net.value, frame["text"].tolist())
            yield pd.DataFrame({"doc_id": frame["doc_id"], "lang_pred": langs, "score": scores})

    found = docs.select("doc_id", "text").mapInPandas(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


QUERIES = {"op5_language": op5_language}
ORACLES: dict[str, str] = {}
