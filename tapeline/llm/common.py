"""Helpers that the corpus operators share: reading tables, cutting lineage, batching texts, distributed ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words are runs of characters other than these.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch; texts can be long, so a batch holds few of them.
BATCH_ROWS = 256
#: And bytes, where rows hold arrays.
BATCH_BYTES = 8 << 20
#: Bytes of text that a Python worker turns into arrays at once; a longer text is a batch of its own.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepared(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches by rows and bytes (texts can be long), where the session has Spark's defaults, and sees that a
    checkpoint folder is set.

    The folder is the one the cluster names in spark.checkpoint.dir. Where it names none, a local session gets one of its
    own, as in tests; on a cluster that would lose data with an executor, so ValueError is raised.
    """
    for name, default, value in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}") == default:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(value))
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and read from the shared checkpoint folder from then on."""
    prepared(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df, computed once into a table of the shared checkpoint folder, where it lies until `dropped`."""
    spark = prepared(df.sparkSession)
    folder = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out._folder = folder
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the tables of `written`; nothing that reads them may run afterwards."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """Whether the row is kept from learning: by crc32 of its id as text."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(modulus)) == remainder


def batches(texts: list[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts as UTF-8) in groups of about limit bytes; null counts as empty."""
    group, first, total = [], 0, 0
    for i, text in enumerate(texts):
        raw = text.encode() if text else b""
        if group and total + len(raw) > limit:
            yield first, group
            group, first, total = [], i, 0
        group.append(raw)
        total += len(raw)
    if group:
        yield first, group


def n_buckets(rows: int) -> int:
    """About the root of the rows, as a power of two: so many buckets, each with so many rows."""
    return 1 << max(4, (max(rows, 1) - 1).bit_length() // 2)


def running(df: DataFrame, keys: list[str], order: list[Column], bucket: Column, value: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same keys that come before, by (bucket, order).

    Two levels: sums of each (keys, bucket) are added up over the buckets, and rows are ordered only within one bucket.
    So a key that holds a third of all rows is spread over as many tasks as there are buckets. df is read twice: store it first.
    """
    df = df.withColumn("_bucket", bucket)
    sums = df.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_sum"))
    starts = sums.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0))).join(starts, [*[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col("_bucket") == F.col("_b")])
    return joined.withColumn(out, F.col("_start") + F.col("_in")).drop("_in", "_start", "_bucket", "_b", *[f"_{k}" for k in keys])


# ---- words of UTF-8 texts as arrays -------------------------------------------------------------------------------

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    if len(_POWERS["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def joined(raws: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes with a space after each text, where each text starts and the end)."""
    buf = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    at = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])])
    return (_LOWER[buf] if lower else buf), at


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; the last flag must be False."""
    edge = np.flatnonzero(np.diff(flags.view(np.int8), prepend=np.int8(0)))
    return edge[0::2], edge[1::2]


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal bytes give equal hashes."""
    up, down = _powers(len(buf) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * up[: len(buf)])])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words_of(raws: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, where texts start, starts of words, ends of words, index of the first word of each text and the end)."""
    buf, at = joined(raws, lower)
    starts, ends = runs_of(~_SPACE[buf])
    return buf, at, starts, ends, np.searchsorted(starts, at)
