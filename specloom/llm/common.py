"""Helpers shared by the training-data operators: inputs, shared scratch folders, Arrow batch limits."""

from __future__ import annotations

import atexit
import ctypes
import gc
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of any contract: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What one Arrow batch sent to a Python worker holds at most.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def limit_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches so that a worker's memory does not depend on the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def lean(f: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """f, the function of a task, which gives freed memory back to the system at its end: workers live on idle."""

    @wraps(f)
    def run(*args: object, **named: object) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(*args, **named)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, or set by setCheckpointDir; only a local session may name none.

    A session on one machine gets a temporary folder. On a cluster executors would not see it, so that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not named and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="specloom-checkpoint-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/specloom/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends, statistics are known."""
    spark, schema = df.sparkSession, df.schema
    path = scratch_path(spark, name)
    df.write.parquet(path)
    del df
    release(spark)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def mark(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small table by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def ascii_lower(c: Column) -> Column:
    """A-Z to lower case, everything else as it is."""
    return F.translate(c, UPPER, LOWER)


def n_words(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(WORD)).cast("long")


def utf8_view(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls, as one uint8 array and n + 1 offsets from 0."""
    array = array.cast(pa.large_string())
    _, offsets, data = array.buffers()
    offs = np.frombuffer(offsets, np.int64, len(array) + 1, array.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


#: Bytes of text that are hashed at once; the tables of powers hold twice as many numbers.
HASH_PIECE = 1 << 18
_FACTOR, _SHIFT, _LENGTH = 0xC2B2AE3D27D4EB4F, np.uint64(0x9E37), np.uint64(0xD6E8FEB86659FD93)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each data[start:end], mixed; equal bytes give equal hashes in any batch.

    Prefix sums of b[i] * M**i modulo 2**64 give every span's hash up to a power of M; multiplying by the
    inverse power (M is odd) makes it independent of the span's place. starts ascend; spans are taken by the
    piece they start in, and what is longer than a piece is summed piece by piece, so memory does not grow
    with the text.
    """
    out = np.zeros(len(starts), np.uint64)
    if not len(starts):
        return out
    power, inverse = _powers()
    piece = np.asarray(starts) // HASH_PIECE
    edges = np.concatenate([[0], np.flatnonzero(np.diff(piece)) + 1, [len(starts)]])
    with np.errstate(over="ignore"):
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            base = int(piece[lo]) * HASH_PIECE
            s, e = starts[lo:hi] - base, ends[lo:hi] - base
            short = e <= 2 * HASH_PIECE
            for k in np.flatnonzero(~short).tolist():
                out[lo + k] = _long_hash(data, base + int(s[k]), base + int(e[k]))
            if short.all():
                out[lo:hi] = _near_hashes(data, base, s, e, power, inverse)
            else:
                out[lo:hi][short] = _near_hashes(data, base, s[short], e[short], power, inverse)
        return mix(out + (ends - starts).astype(np.uint64) * _LENGTH)


def _near_hashes(data: np.ndarray, base: int, s: np.ndarray, e: np.ndarray, power: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    if not len(s):
        return np.zeros(0, np.uint64)
    part = data[base : base + int(e.max())]
    prefix = np.zeros(len(part) + 1, np.uint64)
    np.cumsum((part.astype(np.uint64) + _SHIFT) * power[: len(part)], out=prefix[1:])
    return (prefix[e] - prefix[s]) * inverse[s]


def _long_hash(data: np.ndarray, start: int, end: int) -> np.uint64:
    power, total, scale = _powers()[0], 0, 1
    step = pow(_FACTOR, HASH_PIECE, 1 << 64)
    for a in range(start, end, HASH_PIECE):
        part = data[a : min(end, a + HASH_PIECE)].astype(np.uint64) + _SHIFT
        total += scale * int((part * power[: len(part)]).sum(dtype=np.uint64))
        scale = scale * step % (1 << 64)
    return np.uint64(total % (1 << 64))


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    size = 2 * HASH_PIECE + 1
    return _geometric(_FACTOR, size), _geometric(pow(_FACTOR, -1, 1 << 64), size)


def _geometric(m: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, m, np.uint64)]))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit integers."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).view(np.int8)))
    return edge[::2], edge[1::2]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_spans(texts: pa.Array, lower: bool = True, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, first): words between bytes that break them, else ASCII white space; first has the number of the first word of each text, and the total."""
    data, offsets = utf8_view(texts)
    if lower:
        data = _LOWER[data]
    word = ~breaks[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    start[inner] = word[inner]
    end[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(start)
    return data, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The distinct k-word shingles of each text as sorted 64-bit hashes, words with A-Z in lower case.

    A text of fewer words has its whole sequence as the one shingle, a text without words has none.
    """
    data, starts, ends, first = word_spans(texts)
    h, out = hash_spans(data, starts, ends), []
    step = np.uint64(0x9FB21C651E98DF25)
    with np.errstate(over="ignore"):
        s = h.copy()
        for j in range(1, k):
            s[: len(h) - j] = mix(s[: len(h) - j] * step + h[j:])
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(s[a : b - k + 1]))
            elif b > a:
                one = np.uint64(b - a)
                for x in h[a:b]:
                    one = mix(np.array([one * step + x], np.uint64))[0]
                out.append(np.array([one], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the smallest node of its connected component.

    Alternating large-star and small-star steps, each two joins on the node with minima computed by partial
    aggregates; every round is checkpointed, and the rounds grow with the logarithm of the size.
    """
    e = mark(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    state = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        e = e.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a != b").distinct()
        e = mark(e)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
