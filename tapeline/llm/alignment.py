"""Operator 12: aligning the tokens of two tokenizers over the same bytes."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, prepared, stored, table, written

VOCABULARY = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
#: Id pairs whose counts are sent to every executor (about 60 bytes each); more are joined by a shuffle.
BROADCAST_PAIRS = 2_000_000
_TEXT = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pair array<long>, n array<long>"


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for themselves, the rest count up from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}


class Tokens:
    """One tokenizer: `encode` of texts, the bytes of each id and their lengths."""

    def __init__(self, encode, entries: list[bytes]):
        self.encode, self.entries, self.lengths = encode, entries, np.array([len(x) for x in entries], np.int64)


@lru_cache(maxsize=2)
def byte_level(vocabulary: str) -> Tokens:
    """A byte-level vocabulary file. Texts get a space before them; strings of special tokens in them are plain text.

    The file's merges are ranks of the joined entries, which tiktoken takes; the ids are those of the tokenizers library (tested).
    """
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(vocabulary), encoding="utf-8") as file:
        content = json.load(file)
    alphabet = byte_alphabet()
    special = {x["content"] for x in content["added_tokens"]}
    ranks = {bytes(alphabet[c] for c in entry): i for entry, i in content["model"]["vocab"].items() if entry not in special}
    encoder = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    entries = [b""] * (max(ranks.values()) + 1)
    for entry, i in ranks.items():
        entries[i] = entry
    return Tokens(lambda texts: [encoder.encode_to_numpy(f" {x}", disallowed_special=()) for x in texts], entries)


@lru_cache(maxsize=2)
def piece_level(model: str) -> Tokens:
    """A sentencepiece model, which puts the space before a text itself."""
    import public_tokenizers
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))
    texts = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size())]
    entries = [bytes([int(x[3:5], 16)]) if pieces.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(texts)]
    return Tokens(lambda texts: pieces.encode(texts, num_threads=1), entries)


def _near(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Of each range low <= i < high the i nearest to its middle for which a[i] is in b (the lower of two), or -1.

    Each is looked up by bisection, in rings about the middle that widen only where nothing was found.
    """
    middle, found, none = (low + high) // 2, np.full(len(low), -1), np.iinfo(np.int64).max
    todo, radius = np.arange(len(low)), 0
    while len(todo):
        left, right, centre = np.maximum(low[todo], middle[todo] - radius), np.minimum(high[todo], middle[todo] + radius + 1), middle[todo]
        sizes = right - left
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(left - (ends - sizes), sizes)
        hit = b[np.searchsorted(b, a[at])] == a[at]
        away = at - np.repeat(centre, sizes)
        best = np.minimum.reduceat(np.where(hit, 2 * np.abs(away) + (away > 0), none), ends - sizes)
        ok = best < none
        found[todo[ok]] = centre[ok] + np.where(best[ok] & 1, best[ok] >> 1, -(best[ok] >> 1))
        todo = todo[~ok & ((left > low[todo]) | (right < high[todo]))]
        radius = 4 * radius + 2
    return found


def shared_ends(a: np.ndarray, b: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which ends of `a` are ends of `b` too. Texts are the ranges first <= i < last of a; the last end of a text is in both.

    Divide and conquer: a shared end near the middle of an interval cuts it, both halves are treated alike, and an interval
    without one is a leaf. All intervals of a depth go together.
    """
    shared = np.zeros(len(a), bool)
    shared[last - 1] = True
    low, high = first, last - 1
    while True:
        low, high = low[low < high], high[low < high]
        if not len(low):
            return shared
        cut = _near(a, b, low, high)
        low, high, cut = low[cut >= 0], high[cut >= 0], cut[cut >= 0]
        shared[cut] = True
        low, high = np.concatenate([low, cut + 1]), np.concatenate([cut, high])


def _frame(rows: np.ndarray, doc_ids: list, raws: list[bytes], tokens: tuple[Tokens, Tokens], printed: list[bytes]) -> pd.DataFrame:
    """The rows of `alignments` for texts that one chunk holds."""
    n = len(raws)
    out = {"row": rows, "doc_id": pd.array(doc_ids, dtype="Int64"), **{c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links")}}
    groups, pair, count = [""] * n, [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n
    texts = [raw.decode() for raw in raws]
    # Byte-level ids are those of the text's own bytes, so their lengths settle whether they spell it; pieces are compared.
    ids_a, ids_b = tokens[0].encode(texts), tokens[1].encode(texts)
    spelt = lambda i: tokens[0].lengths[ids_a[i]].sum() == len(raws[i]) + 1 and b"".join(map(tokens[1].entries.__getitem__, ids_b[i])) == b" " + raws[i]
    whole = [i for i in range(n) if raws[i] and spelt(i)]
    if whole:
        n_a, n_b = (np.array([len(ids[i]) for i in whole]) for ids in (ids_a, ids_b))
        a, b = (np.concatenate([np.asarray(ids[i], np.int64) for i in whole]) for ids in (ids_a, ids_b))
        ends_a, ends_b = np.cumsum(tokens[0].lengths[a]), np.cumsum(tokens[1].lengths[b])
        last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
        shared_a = shared_ends(ends_a, ends_b, last_a - n_a, last_a)
        shared_b = np.zeros(len(b), bool)
        shared_b[np.searchsorted(ends_b, ends_a[shared_a])] = True
        # Two tokens overlap in one stretch of bytes that no end cuts, and each such stretch lies in one token of either.
        at_a, at_b = np.zeros(ends_a[-1] + 1, bool), np.zeros(ends_a[-1] + 1, bool)
        at_a[ends_a], at_b[ends_b] = True, True
        stretches = np.flatnonzero(at_a | at_b)
        before = lambda at: (np.cumsum(at, dtype=np.int32) - at)[stretches]
        links = a[before(at_a)] << 32 | b[before(at_b)]
        until = np.searchsorted(stretches, ends_a[last_a - 1], "right")
        # A token is printed with the mark that follows it; a group's tokens of A come before those of B.
        group_a, group_b = np.cumsum(shared_a) - shared_a, np.cumsum(shared_b) - shared_b
        place_a = np.arange(len(a)) + np.concatenate([[0], np.flatnonzero(shared_b) + 1])[group_a]
        place_b = np.arange(len(b)) + (np.flatnonzero(shared_a) + 1)[group_b]
        marks = np.empty(len(a) + len(b), np.int64)
        marks[place_a] = 2 * a + shared_a
        marks[place_b] = 2 * (len(tokens[0].entries) + b) + shared_b
        counted = np.concatenate([[0], np.cumsum(shared_a)])
        start_link, start_mark = 0, 0
        for k, i in enumerate(whole):
            end_mark = start_mark + n_a[k] + n_b[k]
            groups[i] = b"".join(map(printed.__getitem__, marks[start_mark:end_mark].tolist()))[:-1].decode()
            pair[i], count[i] = np.unique(links[start_link : until[k]], return_counts=True)
            start_link, start_mark = until[k], end_mark
        out["n_a"][whole], out["n_b"][whole] = n_a, n_b
        out["n_groups"][whole] = counted[last_a] - counted[last_a - n_a]
        out["n_links"][whole] = np.diff(until, prepend=0)
    return pd.DataFrame(out | {"groups": groups, "pair": pair, "n": count})


def alignments(docs: DataFrame, vocabulary: str = VOCABULARY, model: str = PIECES) -> DataFrame:
    """Per row of docs (doc_id, text): row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups, pair, n.

    Tokens of A are those of a byte-level vocabulary over space and text, those of B the pieces of a sentencepiece model over
    the text. groups is `a1,a2|b1;a3|b2,b3`: the ids between neighbouring byte offsets where tokens of both end. pair has each
    linked A id << 32 | B id once, n how many links of the text it has. Texts that are null or empty, or whose joined bytes of
    either differ from space and text, have no tokens: zeros, '' and empty lists. Whole texts are encoded; repeated rows are
    rows of their own; other columns of docs aren't kept; an empty table gives no rows.
    """
    prepared(docs.sparkSession)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = (byte_level(vocabulary), piece_level(model))
        printed = [b"%d%c" % (i, c) for x, last in zip(tokens, b"|;", strict=True) for i in range(len(x.entries)) for c in (44, last)]
        for frame in frames:
            doc_ids = [None if x != x or x is None else int(x) for x in frame["doc_id"].tolist()]
            for first, raws in batches(frame["text"].tolist()):
                yield _frame(frame["row"].to_numpy()[first : first + len(raws)], doc_ids[first : first + len(raws)], raws, tokens, printed)

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInPandas(work, _TEXT)


def scored(aligned: DataFrame) -> DataFrame:
    """n_best and count_sum of each row of `alignments` (read twice: written before). A pair's count is how many links of all
    rows hold it; n_best counts links whose count is the greatest of their B id, ties included, count_sum adds up the counts.
    """
    links = aligned.select("row", F.explode(F.arrays_zip("pair", "n")).alias("_")).select("row", "_.pair", "_.n")
    counts = stored(links.groupBy("pair").agg(F.sum("n").alias("count")))
    id_b = F.col("pair").bitwiseAND(0xFFFFFFFF)
    best = counts.groupBy(id_b.alias("b")).agg(F.max("count").alias("most"))  # at most one row an entry of the model
    counts = counts.join(F.broadcast(best), id_b == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    counts = F.broadcast(counts) if counts.count() <= BROADCAST_PAIRS else counts
    sums = links.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    return aligned.drop("pair", "n").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignments(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return scored(written(aligned.withColumn("groups_sha256", digest).drop("groups"))).drop("row")


QUERIES = {"op12_align": op12_align}
ORACLES: dict[str, str] = {}
