"""Operator 2: packing documents into sequences by minimum bin slack."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import n_buckets, prepared, running, stored, table

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0


@lru_cache(maxsize=2)
def _encoder(vocabulary: str):
    """Text to its ids as little-endian unsigned 32-bit bytes.

    The ids are those of the vocabulary file in the tokenizers library. Its ranks are also given for tiktoken, which
    finds the same ids several times faster; a text that holds a special token's string goes to the former.
    """
    import base64

    import numpy as np
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    with open(public_tokenizers.path(vocabulary.replace(".json", ".tiktoken")), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> bytes:
        if "<|" in text:
            return np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()

    return encode


def pieces_of(docs: DataFrame, capacity: int = 2048, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece: a document is one, or more if it is longer than a sequence.

    Null texts are empty and have one piece: the end id. Only the first piece of a longer one may be shorter than a sequence.
    """

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = _encoder(vocabulary), END_ID.to_bytes(4, "little")
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                ids = (encode(text) if text else b"") + end
                n = len(ids) // 4
                at, first = 0, (n - 1) % capacity + 1
                for piece, stop in enumerate(range(first, n + 1, capacity)):
                    rows.append((doc_id, piece, at, stop - at, zlib.crc32(ids[4 * at : 4 * stop])))
                    at = stop
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fill(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The fullest combination (length, copies) that holds the greatest available length; greater lengths first.

    The reachable sums of the lengths are the bits of one integer; copies are added by powers of two.
    """
    lengths = sorted((x for x, n in counts.items() if n), reverse=True)
    seed = lengths[0]
    room, mask = capacity - seed, (1 << (capacity - seed + 1)) - 1
    sums, steps = 1, []
    for length in lengths:
        most = min(counts[length] - (length == seed), room // length)
        part = 1
        while most > 0:
            n = min(part, most)
            steps.append((length, n, sums))
            sums |= (sums << (length * n)) & mask
            most -= n
            part *= 2
        if sums >> room:
            break
    at, chosen = sums.bit_length() - 1, {seed: 1}
    for length, n, before in reversed(steps):
        if not before >> at & 1:
            at -= length * n
            chosen[length] = chosen.get(length, 0) + n
    return sorted(chosen.items(), reverse=True)


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, combination) until nothing is left: a combination fills bins as long as each of its lengths lasts.

    Nothing that was fuller becomes possible by taking lengths away, so these are the bins that one search a bin would give.
    Each pattern uses up at least one length, so there are no more patterns than lengths.
    """
    counts, found = {k: v for k, v in counts.items() if v}, []
    while counts:
        chosen = fill(counts, capacity)
        bins = min(counts[length] // n for length, n in chosen)
        found.append((bins, chosen))
        for length, n in chosen:
            counts[length] -= bins * n
            if not counts[length]:
                del counts[length]
    return found


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every document's pieces with the sequence they go to and their place there.

    docs: doc_id, text. The only thing the driver sees is how many pieces have each length, at most `capacity` numbers
    at any size of the input; from these, minimum bin slack plans all bins. Pieces of a length are numbered over the
    cluster (see running()) and find their bin by their number. Repeated rows are packed once each; an empty table gives
    no rows; other columns of docs aren't kept.
    """
    spark = prepared(docs.sparkSession)
    pieces = stored(pieces_of(docs, capacity, vocabulary).withColumn("one", F.lit(1).cast("long")).withColumn("h", F.xxhash64("doc_id", "piece", "ids_crc32")))
    counts = {row["length"]: row["n"] for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    parts, first, used = [], 0, dict.fromkeys(counts, 0)
    for bins, chosen in patterns(counts, capacity):
        offset = 0
        for length, n in chosen:
            parts.append((length, used[length], used[length] + bins * n, first, n, offset))
            used[length] += bins * n
            offset += length * n
        first += bins
    plan = spark.createDataFrame(parts, "len long, rank_from long, rank_to long, first_bin long, copies long, base long")
    ranked = running(pieces, ["length"], [F.col("h"), F.col("doc_id"), F.col("piece")], F.pmod("h", F.lit(n_buckets(sum(counts.values())))), "one", "rank")
    # At most capacity / 2 patterns hold a length twice over, and at most 2 * sqrt(capacity) lengths are in one: the plan's size is bounded.
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("len")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    nth = F.col("rank") - F.col("rank_from")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_bin") + F.floor(nth / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("base") + nth % F.col("copies") * F.col("length")).cast("long").alias("offset"),
    )


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op2_pack": op2_pack}
ORACLES: dict[str, str] = {}
