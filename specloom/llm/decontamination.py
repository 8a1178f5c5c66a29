"""Benchmark decontamination: n-gram seeds join passages to test items, Smith-Waterman alignment scores them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm.common import cut, documents, hash_spans, lean, limit_batches, mix, word_spans

#: Tokens are runs of letters and digits; all bytes beyond ASCII count as letters.
_BREAKS = np.ones(256, bool)
_BREAKS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False
#: Every n-gram of an item is a seed: which ones an edited copy keeps cannot be told from other documents.
SEED_TOKENS = 3
#: Longer items are aligned part by part; of items under WHOLE tokens only exact copies are evidence.
SEGMENT, STRIDE, WHOLE = 64, 32, 8
#: Tokens by which an alignment may leave the diagonal of its seed.
SLACK = 16
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of the score of an exact copy from which a passage is a leak.
MIN_SCORE = 0.5
#: Bits of the filter that the scan of the documents carries, whatever the size of the benchmark.
FILTER_BITS = 1 << 24
#: Seeds up to which their table goes to each worker, about 20 bytes each and 512 a segment; beyond it the join shuffles.
BROADCAST_SEEDS = 100_000
#: Hits that leave the scan of the documents at once, about 1.3 kB each.
HITS = 4096


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the tokens of all texts, number of each text's first token, and the total)."""
    data, starts, ends, first = word_spans(pc.utf8_lower(texts.cast(pa.large_string())), False, _BREAKS)
    return hash_spans(data, starts, ends), first


def grams(h: np.ndarray, first: np.ndarray, n: int = SEED_TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, token) of each n-gram that lies in one text."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + first[text]
    g = h[at]
    with np.errstate(over="ignore"):
        for j in range(1, n):
            g = mix(g * np.uint64(0x9FB21C651E98DF25) + h[at + j])
    return g, text, at


@lean
def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, seg, at, n, h, tokens) for each n-gram of each segment; of an item under WHOLE tokens the first is enough."""
    for b in batches:
        h, first = tokens(b.column("text"))
        ids, rows = b.column("item_id").to_pylist(), []
        for i, a, z in zip(ids, first[:-1].tolist(), first[1:].tolist(), strict=True):
            starts = sorted({*range(a, max(a + 1, z - SEGMENT), STRIDE), max(a, z - SEGMENT)})
            for seg, s in enumerate(starts if z > a else []):
                part = h[s : min(z, s + SEGMENT)]
                n, most = min(SEED_TOKENS, len(part)), 1 if z - a < WHOLE else SEGMENT
                g, _, at = grams(part, np.array([0, len(part)]), n)
                rows += [(i, seg, k, n, x, part.view(np.int64)) for k, x in zip(at[:most].tolist(), g[:most].view(np.int64).tolist(), strict=True)]
        cols = list(zip(*rows, strict=True)) or [[]] * 6
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["item_id", "seg", "at", "n", "h", "tokens"])


def _filter(keys: DataFrame) -> np.ndarray:
    """A bit for each hash modulo FILTER_BITS: 2 MB at most reach the driver, however many keys there are."""
    slot = F.pmod("h", F.lit(FILTER_BITS))
    words = keys.select((slot / 32).cast("int").alias("w"), F.pmod(slot, F.lit(32)).cast("int").alias("b")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v")).toPandas()
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    bits[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64).astype(np.uint32)
    return bits


def _passing(g: np.ndarray, bits: np.ndarray) -> np.ndarray:
    slot = (g & np.uint64(FILTER_BITS - 1)).astype(np.int64)
    return np.flatnonzero(bits[slot >> 5] >> (slot & 31).astype(np.uint32) & np.uint32(1))


@lean
def _hits(batches: Iterator[pa.RecordBatch], bits: np.ndarray, sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """(h, doc_id, place, base, around): a seed's place in its text, and the tokens around it from base on."""
    for b in batches:
        h, first = tokens(b.column("text"))
        g, text, at = (np.concatenate(x) for x in zip(*(grams(h, first, n) for n in sizes), strict=True))
        passing = _passing(g, bits)
        for k in range(0, len(passing), HITS):
            i = passing[k : k + HITS]
            t, p = text[i], at[i]
            lo, hi = np.maximum(first[t], p - SEGMENT - SLACK), np.minimum(first[t + 1], p + SEGMENT + SLACK)
            n = hi - lo
            flat = h[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].view(np.int64)
            around = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat))
            cols = [pa.array(g[i].view(np.int64)), b.column("doc_id").take(pa.array(t)), pa.array((p - first[t]).astype(np.int32)), pa.array((lo - first[t]).astype(np.int32)), around]
            yield pa.RecordBatch.from_arrays(cols, ["h", "doc_id", "place", "base", "around"])


def align(items: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best local score, end in the passage) of each row of items with the row of passages, padded with -1 and -2.

    One item token a step for all rows at once: a gap in the item is a running maximum along the passage.
    """
    rows, width = passages.shape
    j = (np.arange(width + 1) * -GAP).astype(np.int32)
    last, best, end = np.zeros((rows, width + 1), np.int32), np.zeros(rows, np.int32), np.zeros(rows, np.int64)
    for i in range(items.shape[1]):
        now = np.zeros((rows, width + 1), np.int32)
        now[:, 1:] = np.maximum(last[:, :-1] + np.where(items[:, i : i + 1] == passages, MATCH, MISMATCH), last[:, 1:] + GAP)
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + j, axis=1) - j
        top = now.argmax(1)
        value = now[np.arange(rows), top]
        better = value > best
        best[better], end[better], last = value[better], top[better], now
    return best, end


def _padded(lists: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(lists), max(map(len, lists), default=0)), fill, np.int64)
    for row, x in zip(out, lists, strict=True):
        row[: len(x)] = x
    return out


@lean
def _scored(batches: Iterator[pa.RecordBatch], min_score: float) -> Iterator[pa.RecordBatch]:
    """(doc_id, item_id, score, start, end) of each passage whose alignment reaches min_score; start and end count tokens."""
    for b in batches:
        diagonal = (b.column("place").to_numpy() - b.column("at").to_numpy()) // SLACK
        seen, todo = set(), []
        for i, key in enumerate(zip(b.column("doc_id").to_pylist(), b.column("item_id").to_pylist(), b.column("seg").to_pylist(), diagonal.tolist(), strict=True)):
            if key not in seen:
                seen.add(key)
                todo.append(i)
        part = b.take(pa.array(todo, pa.int64()))
        out: list[tuple] = []
        for k in range(0, part.num_rows, 1024):
            p = part.slice(k, 1024)
            items = [np.array(x, np.int64) for x in p.column("tokens").to_pylist()]
            near, base = [], []
            for around, lo, place, at, item in zip(p.column("around").to_pylist(), p.column("base").to_pylist(), p.column("place").to_pylist(), p.column("at").to_pylist(), items, strict=True):
                s = max(0, place - at - SLACK - lo)
                near.append(np.array(around[s : place - at + len(item) + SLACK - lo], np.int64))
                base.append(lo + s)
            full = np.array([MATCH * len(x) for x in items])
            least = np.where(full < MATCH * WHOLE, full, min_score * full)
            left, right = _padded(items, -1), _padded(near, -2)
            # no alignment scores more than all the item's tokens that stand in the passage at all
            able = np.flatnonzero(MATCH * (left[:, :, None] == right[:, None, :]).any(2).sum(1) >= least)
            best, end = np.zeros(len(full), np.int32), np.zeros(len(full), np.int64)
            best[able], end[able] = align(left[able], right[able])
            good = np.flatnonzero(best >= least)
            if len(good):
                _, tail = align(_padded([items[i][::-1] for i in good], -1), _padded([near[i][: end[i]][::-1] for i in good], -2))
                docs, ids = p.column("doc_id").to_pylist(), p.column("item_id").to_pylist()
                out += [(docs[i], ids[i], round(float(best[i] / full[i]), 6), int(base[i] + end[i] - t), int(base[i] + end[i])) for i, t in zip(good, tail, strict=True)]
        cols = list(zip(*out, strict=True)) or [[]] * 5
        types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "item_id", "score", "start", "end"])


def _pairs(hits: pa.RecordBatch, seeds: pa.Table, segments: pa.Table) -> Iterator[pa.RecordBatch]:
    """Hits with the seeds of their hash, HITS pairs at a time; seeds (h, at, segment) are in order of h, segments (item_id, seg, tokens) named by their row."""
    keys, h = seeds.column("h").to_numpy(), hits.column("h").to_numpy()
    lo, hi = np.searchsorted(keys, h), np.searchsorted(keys, h, side="right")
    n = hi - lo
    left = np.repeat(np.arange(len(h)), n)
    right = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    for k in range(0, len(left), HITS):
        a, b = hits.take(pa.array(left[k : k + HITS])), seeds.take(pa.array(right[k : k + HITS]))
        c = segments.take(b.column("segment")).combine_chunks()
        cols = {name: a.column(name) for name in ("doc_id", "place", "base", "around")} | {"at": b.column("at").combine_chunks()} | {name: c.column(name).combine_chunks() for name in ("item_id", "seg", "tokens")}
        yield pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


@lean
def _found(batches: Iterator[pa.RecordBatch], bits: np.ndarray, sizes: list[int], seeds: pa.Table, segments: pa.Table, min_score: float) -> Iterator[pa.RecordBatch]:
    """Hits, joined with their seeds and scored, in one worker a task."""
    for hits in _hits(batches, bits, sizes):
        for pairs in _pairs(hits, seeds, segments):
            yield from _scored(iter([pairs]), min_score)


def _tables(seeds: DataFrame) -> tuple[pa.Table, pa.Table]:
    """Seeds and segments of a small benchmark on the driver; see _pairs."""
    segments = seeds.groupBy("item_id", "seg").agg(F.first("tokens").alias("tokens")).toArrow()
    number = {key: i for i, key in enumerate(zip(*(segments.column(c).to_pylist() for c in ("item_id", "seg")), strict=True))}
    rows = seeds.select("h", "at", "item_id", "seg").toArrow().sort_by("h")
    of = [number[key] for key in zip(*(rows.column(c).to_pylist() for c in ("item_id", "seg")), strict=True)]
    return rows.select(["h", "at"]).append_column("segment", pa.array(of, pa.int64())).combine_chunks(), segments.combine_chunks()


def decontamination(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """Return (doc_id, item_id, score, start, end): each document that holds a passage like a test item, once per item.

    score is the best local alignment of tokens (lower-cased runs of letters and digits) over that of an exact
    copy, in [min_score, 1]; start and end are the passage's tokens in the document. Of an item of fewer than
    WHOLE tokens only an exact copy counts. Null texts and texts without tokens match nothing; repeated rows of
    a document or an item give one row; a null doc_id is a document like others. Other columns are ignored.

    Every n-gram of an item is a seed, so whether a document is found depends on it and the item alone: a
    passage that shares SEED_TOKENS tokens in a row with the item is aligned. One that shares none, such as a
    copy with every third word replaced, is not found, though it may score a little over 0.5.
    One scan of the documents, with a filter of 2 MB at most, finds the seeds with the tokens around them, so
    that no text is shuffled. What an item's tokens in a passage cannot bring to min_score is not aligned.
    Up to broadcast_seeds seeds go to the workers, at most some 5 MB, and are joined and aligned where the
    documents are read; beyond, hits and seeds are joined by a shuffle that skew can split.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    seeds = cut(items.mapInArrow(_items, "item_id long, seg int, at int, n int, h long, tokens array<long>"), "decontam-seeds")
    chosen = _filter(seeds.select("h"))
    sizes = sorted(r.n for r in seeds.select("n").distinct().collect()) or [SEED_TOKENS]
    out = "doc_id long, item_id long, score double, start long, end long"
    if seeds.count() <= broadcast_seeds:
        table, segments = _tables(seeds)
        scored = rows.mapInArrow(lambda it: _found(it, chosen, sizes, table, segments, min_score), out)
    else:
        found = rows.mapInArrow(lambda it: _hits(it, chosen, sizes), "h long, doc_id long, place int, base int, around array<long>")
        scored = found.join(seeds, "h").mapInArrow(lambda it: _scored(it, min_score), out)
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", -F.col("start"), -F.col("end"))).alias("b"))
    return best.select("doc_id", "item_id", "b.score", (-F.col("b.col2")).alias("start"), (-F.col("b.col3")).alias("end"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
