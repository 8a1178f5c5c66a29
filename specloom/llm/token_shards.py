"""Token ids as binary shards: one Parquet file a shard, whose rows hold wavelet matrices of whole documents."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specloom.llm.common import documents, hash_spans, lean, limit_batches, scratch_path, utf8_view
from specloom.llm.wavelet import WaveletMatrix

END_ID = 1
#: A row of a shard closes when it holds this many ids; one document is never split.
SEGMENT_IDS = 1 << 18
#: Bytes of distinct words whose ids a worker remembers, 4 times as many with the ids; it forgets all of them when there are more.
CACHED_BYTES = 10 << 20
SHARD_SCHEMA = "shard int, seg int, n_docs int, n_ids long, doc_ids binary, no_id binary, lengths binary, planes binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Letters, then marks which never join them in a pre-token; nothing here changes its class in lower case or by composition.
_PLAIN = re.compile(r"[a-zA-ZÀ-ÖØ-öø-ÿ]+([.,!?;:*&%$#|]*)")
#: Bytes of text that are encoded at once, whole texts.
SLICE_BYTES = 1 << 20
#: New words that are encoded in one text.
JOINED = 1000


class WordEncoder:
    """Encodes texts word by word, each distinct word once.

    The tokenizer cuts its pre-tokens at white space and nothing in its normalizer crosses it, so a text's ids
    are those of its words one after the other. New words that are letters, or letters and a few marks after
    them, go to the library in joined texts: they give one or two pre-tokens, and the last piece of each is a
    word end; where the count of ends is not what it should be, they are encoded one by one.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.is_end = np.zeros(1 << 16, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.is_end[i] = token.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        """Words are found by the hash of their bytes in `keys`, in order, and compared byte by byte in `pool`."""
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.pool, self.pool_at = np.zeros(0, np.uint8), np.zeros(1, np.int32)
        self.flat, self.ids_at = np.zeros(0, np.uint16), np.zeros(1, np.int32)

    def _known(self, h: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The slot of each word, or -1."""
        if not len(self.keys):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        slot = np.where(self.keys[at] == h, self.slots[at], np.int32(-1)).astype(np.int64)
        size = np.diff(offsets)
        slot[(slot >= 0) & (self.pool_at[slot + 1] - self.pool_at[slot] != size)] = -1
        i = np.flatnonzero(slot >= 0)
        n = size[i]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        same = self.pool[np.repeat(self.pool_at[slot[i]], n) + within] == data[np.repeat(offsets[i], n) + within]
        slot[i[~np.logical_and.reduceat(same, np.cumsum(n) - n)] if len(i) else i] = -1
        return slot

    def _keep(self, h: np.ndarray, words: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Remember new words with their ids and return their slots."""
        data, offsets = utf8_view(words)
        new = np.arange(len(self.pool_at) - 1, len(self.pool_at) - 1 + len(h), dtype=np.int32)
        self.pool, self.pool_at = np.concatenate([self.pool, data]), np.concatenate([self.pool_at, (self.pool_at[-1] + offsets[1:]).astype(np.int32)])
        self.flat, self.ids_at = np.concatenate([self.flat, ids]), np.concatenate([self.ids_at, (self.ids_at[-1] + np.cumsum(lengths)).astype(np.int32)])
        keys, slots = np.concatenate([self.keys, h]), np.concatenate([self.slots, new])
        order = np.argsort(keys, kind="stable")
        self.keys, self.slots = keys[order], slots[order]
        return new

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, ids of each)."""
        ends = np.array([0 if not m else 2 if m[1] else 1 for m in map(_PLAIN.fullmatch, words)], np.int64)
        plain = np.flatnonzero(ends)
        parts, found, single = [plain[k : k + JOINED] for k in range(0, len(plain), JOINED)], [], [np.flatnonzero(ends == 0)]
        joined = [" ".join([words[i] for i in part.tolist()]) for part in parts]
        for part, e in zip(parts, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids, want = np.array(e.ids, np.uint16), np.cumsum(ends[part])
            at = np.flatnonzero(self.is_end[ids]) + 1
            if len(at) == want[-1]:
                found.append((part, ids, np.diff(at[want - 1], prepend=0)))
            else:
                single.append(part)
        rest = np.concatenate(single)
        for k in range(0, len(rest), 4096):
            part = rest[k : k + 4096]
            lists = [e.ids for e in self.tokenizer.encode_batch_fast([words[i] for i in part.tolist()], add_special_tokens=False)]
            found.append((part, np.array([i for x in lists for i in x], np.uint16), np.array([len(x) for x in lists], np.int64)))
        order = np.concatenate([x[0] for x in found])
        ids, lengths = np.concatenate([x[1] for x in found]), np.concatenate([x[2] for x in found])
        back = np.argsort(order, kind="stable")
        return ids[_spread((np.cumsum(lengths) - lengths)[back], lengths[back])], lengths[back]

    def encode(self, texts: pa.Array, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, ids of each text); with end_id after each text."""
        if len(self.pool) > CACHED_BYTES:
            self.forget()
        words = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        offsets = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_string())
        data, bounds = utf8_view(distinct)
        h = hash_spans(data, bounds[:-1], bounds[1:])
        slot = self._known(h, data, bounds)
        new = np.flatnonzero(slot < 0)
        if len(new):
            taken = distinct.take(pa.array(new))
            slot[new] = self._keep(h[new], taken, *self._encoded(taken.to_pylist()))
        coded = coded.indices.to_numpy()
        lengths = (self.ids_at[slot + 1] - self.ids_at[slot]).astype(np.int32)[coded]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        at = _spread(self.ids_at[slot].astype(np.int32)[coded], lengths)
        ids, per = self.flat[at], np.diff(upto[offsets - offsets[0]])
        if end_id is None:
            return ids, per
        out = np.full(len(ids) + len(per), end_id, np.uint16)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(per)), per)] = ids
        return out, per + 1


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one after the other."""
    ends = np.cumsum(lengths, dtype=starts.dtype)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(lengths.sum()), dtype=starts.dtype)


_ENCODERS: dict[str, WordEncoder] = {}


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows in a row whose texts begin within SLICE_BYTES of one another."""
    begins = utf8_view(batch.column("text"))[1][:-1] // SLICE_BYTES
    edges = np.concatenate([[0], np.flatnonzero(np.diff(begins)) + 1, [len(begins)]])
    for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if z > a:
            yield batch.slice(a, z - a)


@lean
def _segments(batches: Iterator[pa.RecordBatch], path: str, segment_ids: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    encoder = _ENCODERS[path]
    shard, seg, held = TaskContext.get().partitionId(), 0, []

    def close() -> pa.RecordBatch:
        ids, lengths, docs = (np.concatenate([x[k] for x in held]) for k in range(3))
        no_id = np.concatenate([x[3] for x in held])
        row = [shard, seg, len(lengths), len(ids), docs.astype("<i8").tobytes(), np.packbits(no_id).tobytes(), lengths.astype("<i8").tobytes(), WaveletMatrix.build(ids).to_bytes()]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], ["shard", "seg", "n_docs", "n_ids", "doc_ids", "no_id", "lengths", "planes"])

    for b in (part for batch in batches for part in _slices(batch)):
        ids, lengths = encoder.encode(b.column("text"))
        docs = b.column("doc_id")
        docs, no_id = docs.fill_null(0).to_numpy(zero_copy_only=False), docs.is_null().to_numpy(zero_copy_only=False)
        upto, at = np.concatenate([[0], np.cumsum(lengths)]), 0
        while at < len(lengths):
            free = segment_ids - sum(len(x[0]) for x in held)
            end = min(len(lengths), max(at, int(np.searchsorted(upto, upto[at] + free))))
            held.append((ids[upto[at] : upto[end]], lengths[at:end], docs[at:end], no_id[at:end]))
            if upto[end] - upto[at] >= free:
                yield close()
                seg, held = seg + 1, []
            at = end
    if held:
        yield close()


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode each text, append END_ID, and write ids in ascending doc_id order as wavelet matrices under path.

    Documents are dealt by ranges of doc_id (nulls first), one file a range; rows of one id are ordered by a
    digest of their texts and then by the texts, so reruns agree, and many such rows spread over files. Null
    texts are empty. Extra columns are ignored; repeated rows are written as often as they come. Spark's
    writer makes the files, so path may be any store that the cluster shares, and a lost task is run again
    without leaving half a file. A worker holds one segment, one batch and CACHED_BYTES of words.
    """
    limit_batches(docs.sparkSession)
    path_of = tokenizer or default_tokenizer()
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).withColumn("digest", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest", "text").select("doc_id", "text")
    ordered.mapInArrow(lambda it: _segments(it, path_of, segment_ids), SHARD_SCHEMA).write.option("compression", "none").parquet(path)


@lean
def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            ids, lengths = WaveletMatrix.from_bytes(r["planes"]).decode(), np.frombuffer(r["lengths"], "<i8")
            no_id = np.unpackbits(np.frombuffer(r["no_id"], np.uint8), count=r["n_docs"]).view(bool)
            starts, wide = np.cumsum(lengths) - lengths, ids.astype("<u4")
            crc = [zlib.crc32(wide[a : a + n]) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
            same = np.ones(r["n_docs"], np.int32)
            cols = [pa.array(same * r["shard"]), pa.array(same * r["seg"]), pa.array(np.frombuffer(r["doc_ids"], "<i8"), pa.int64(), mask=no_id), pa.array(starts), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["shard", "seg", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards under path.

    start counts the ids of all documents before it: totals per shard are summed over shards, one row each,
    and totals per segment within a shard. Ids are decoded where the file is read; only these rows move.
    """
    limit_batches(spark)
    files = spark.read.parquet(path)
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    shards = shards.select("shard", (F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("before"))
    within = Window.partitionBy("shard").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)
    segs = files.select("shard", "seg", (F.sum("n_ids").over(within) - F.col("n_ids")).alias("inside")).join(shards, "shard")
    found = files.select("shard", "seg", "n_docs", "doc_ids", "no_id", "lengths", "planes").mapInArrow(_documents, "shard int, seg int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return found.join(segs, ["shard", "seg"]).select("doc_id", (F.col("before") + F.col("inside") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def count_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(shard, seg, n): how often token stands in each segment, from two ranks a plane."""

    @lean
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [WaveletMatrix.from_bytes(x.as_py()).count(token) for x in b.column("planes")]
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("seg"), pa.array(n, pa.int64())], ["shard", "seg", "n"])

    return spark.read.parquet(path).select("shard", "seg", "planes").mapInArrow(counted, "shard int, seg int, n long")


def find_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(shard, seg, at): the places of token in each segment, by select."""

    @lean
    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, seg, blob in zip(*(b.column(c).to_pylist() for c in ("shard", "seg", "planes")), strict=True):
                at = np.array(WaveletMatrix.from_bytes(blob).occurrences(token), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), v, np.int32)) for v in (shard, seg)] + [pa.array(at)], ["shard", "seg", "at"])

    return spark.read.parquet(path).select("shard", "seg", "planes").mapInArrow(located, "shard int, seg int, at long")


def token_shards(docs: DataFrame, path: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Write docs as shards under path and return what the files say of each document (see read_index)."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-shards")
    write_shards(docs, path, tokenizer)
    return read_index(spark, path)


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(documents(spark, sf_dir))
