"""Suffix-array deduplication: remove every byte of a long string that also starts elsewhere in the collection."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm.column_bwt import repeated
from specloom.llm.common import cut, documents, hash_spans, lean, limit_batches, runs, utf8_view
from specloom.llm.winnow import anchors, gram_hashes

WINDOW, GRAM = 200, 64
#: Strings that one transform is built over, at least, where there are as many; a group is never divided.
BUILD_STRINGS = 4096
#: Distinct strings beyond which a group's windows are counted over the cluster instead.
GROUP_STRINGS = 16384
_N, _V = 8, 24  # bits of a fragment's windows and of its text's second digest, beside 32 of its start


@lean
def _fragments(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        h, g, text, start, n, tied = anchors(*utf8_view(b.column("text")), window, gram)
        at = (start << (_N + _V)) | (n << _V) | b.column("v").to_numpy()[text]
        cols = [pa.array(h.view(np.int64)), pa.array(g.view(np.int64)), pa.array(b.column("t").to_numpy()[text]), pa.array(at), pa.array(1 + tied.astype(np.int64))]
        yield pa.RecordBatch.from_arrays(cols, ["h", "g", "t", "at", "times"])


@lean
def _cut_out(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: dict[str, list] = {"h": [], "g": [], "w": [], "bytes": []}
        for text, reps in zip(b.column("text").to_pylist(), b.column("reps").to_pylist(), strict=True):
            data = text.encode()
            for r in reps:
                start, n = r["at"] >> (_N + _V), (r["at"] >> _V) & ((1 << _N) - 1)
                for k, v in (("h", r["h"]), ("g", r["g"]), ("w", r["w"]), ("bytes", data[start : start + n + window - 1])):
                    out[k].append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out["h"], pa.int64()), pa.array(out["g"], pa.int64()), pa.array(out["w"], pa.int64()), pa.array(out["bytes"], pa.binary())], ["h", "g", "w", "bytes"])


def _spans(found: list[np.ndarray], h: list[int], g: list[int], window: int) -> pa.RecordBatch:
    """(h, g, from, to): byte ranges of each fragment to remove; a fragment without any has no row."""
    rows: tuple[list, ...] = ([], [], [], [])
    for mask, *key in zip(found, h, g, strict=True):
        for a, z in zip(*runs(mask), strict=True):
            for column, v in zip(rows, (*key, a, z + window - 1), strict=True):
                column.append(int(v))
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], ["h", "g", "from", "to"])


def starts_repeated(strings: list[bytes], weights: np.ndarray, groups: list[int], window: int) -> list[np.ndarray]:
    """For each string, which window starts hold a string that also starts elsewhere in its group, by the ordered suffixes.

    Digests of windows say first what may be equal, and nothing equal is passed over: strings are cut to where
    such windows lie and equal cuts become one string with their weights' sum. What no other string of the
    group differs from needs no order; over the rest the transform is built.
    """
    n = np.array([max(len(x) - window + 1, 0) for x in strings], np.int64)
    base = np.cumsum([0, *map(len, strings[:-1])])
    owner = np.repeat(np.arange(len(strings)), n)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    place = base[owner] + at
    digest = hash_spans(np.frombuffer(b"".join(strings), np.uint8), place, place + window)
    _, code, count = np.unique(digest, return_inverse=True, return_counts=True)
    lone = np.bincount(code, weights[owner] == 1) > 0
    open_ = np.flatnonzero((count > 1)[code] & lone[code])
    out = [np.full(k, w > 1) for k, w in zip(n, weights, strict=True)]
    if not len(open_):
        return out
    who, first = np.unique(owner[open_], return_index=True)
    last = np.append(first[1:], len(open_)) - 1
    cuts: dict[tuple[int, bytes], int] = {}
    total: list[int] = []
    mine = []
    for i, a, z in zip(who.tolist(), at[open_[first]].tolist(), at[open_[last]].tolist(), strict=True):
        k = cuts.setdefault((groups[i], strings[i][a : z + window]), len(total))
        if k == len(total):
            total.append(0)
        total[k] += int(weights[i])
        mine.append((i, a, k))
    alone = Counter(g for g, _ in cuts)
    texts = list(cuts)
    order = [k for k, (g, _) in enumerate(texts) if alone[g] > 1 or total[k] == 1]
    masks = dict(zip(order, repeated([texts[k][1] for k in order], np.array([total[k] for k in order], np.int64), window), strict=True))
    for i, a, k in mine:
        mask = masks.get(k, np.ones(len(texts[k][1]) - window + 1, bool))
        out[i][a : a + len(mask)] |= mask
    return out


@lean
def _transforms(batches: Iterator[pa.RecordBatch], window: int, least: int) -> Iterator[pa.RecordBatch]:
    """Whole groups of one h, which come in order, are put together until there are `least` strings."""
    h: list[int] = []
    g: list[int] = []
    w: list[int] = []
    s: list[bytes] = []

    def done(n: int) -> pa.RecordBatch:
        out = _spans(starts_repeated(s[:n], np.array(w[:n], np.int64), h[:n], window), h[:n], g[:n], window)
        for x in (h, g, w, s):
            del x[:n]
        return out

    for b in batches:
        for mine, name in ((h, "h"), (g, "g"), (w, "w"), (s, "bytes")):
            mine.extend(b.column(name).to_pylist())
        if len(h) > least and h[0] != h[-1]:
            n = len(h)
            while n and h[n - 1] == h[-1]:
                n -= 1
            yield done(n)
    if h:
        yield done(len(h))


@lean
def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for h, g, w, s in zip(*(b.column(c).to_pylist() for c in ("h", "g", "w", "bytes")), strict=True):
            x = gram_hashes(np.frombuffer(s, np.uint8), window).view(np.int64)
            same = np.ones(len(x), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(same * h), pa.array(same * g), pa.array(np.arange(len(x))), pa.array(x), pa.array(same * w)], ["h", "g", "at", "x", "w"])


@lean
def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
            data = text.encode()
            n_bytes.append(len(data))
            if not spans:
                n_removed.append(0)
                n_spans.append(0)
                kept.append(data)
                continue
            edge = np.zeros(len(data) + 1, np.int32)
            np.add.at(edge, [x["from"] for x in spans], 1)
            np.add.at(edge, [x["to"] for x in spans], -1)
            gone = np.cumsum(edge[:-1]) > 0
            n_removed.append(int(gone.sum()))
            n_spans.append(len(runs(gone)[0]))
            kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
        sha = [hashlib.sha256(k).hexdigest() for k in kept]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])


def removals(rows: DataFrame, window: int = WINDOW, gram: int = GRAM, group_strings: int = GROUP_STRINGS) -> DataFrame:
    """(t, v, from, to): byte ranges covered by strings of `window` bytes that start elsewhere too, from (t, v, text).

    t and v are digests of the text, so equal rows are told of once, and each gives its fragments.
    """
    fragments = cut(rows.mapInArrow(lambda it: _fragments(it, window, gram), "h long, g long, t long, at long, times long"), "suffix-all")
    again = fragments.groupBy("h").agg(F.sum("times").alias("times")).where("times > 1").select("h")
    found = fragments.join(again, "h").groupBy("h", "g", "t", "at").agg(F.count("*").alias("n"), F.max("times").alias("times"))
    found = cut(found, "suffix-fragments")
    v = F.col("at").bitwiseAND((1 << _V) - 1)
    start, end = F.shiftright("at", _N + _V), F.shiftright("at", _N + _V) + F.shiftright("at", _V).bitwiseAND((1 << _N) - 1) + F.lit(window - 1)
    distinct = found.groupBy("h", "g").agg(F.sum("n").alias("w"), F.max("times").alias("times"), F.min(F.struct("t", "at")).alias("rep"))
    groups = distinct.groupBy("h").agg(F.count("*").alias("strings"), F.max("times").alias("times"))
    mixed = groups.where("strings > 1 or times > 1").select("h", (F.col("strings") > group_strings).alias("hot"))
    kinds = cut(mixed, "suffix-groups")
    copies = found.join(kinds, "h", "left_anti").select("t", v.alias("v"), start.alias("from"), end.alias("to"))
    reps = distinct.join(kinds, "h").select(F.col("rep.t").alias("t"), F.col("rep.at").bitwiseAND((1 << _V) - 1).alias("v"), F.struct("h", "g", "w", "rep.at").alias("r"))
    reps = reps.groupBy("t", "v").agg(F.collect_list("r").alias("reps"))
    texts = rows.groupBy("t", "v").agg(F.first("text").alias("text"))
    strings = cut(texts.join(reps, ["t", "v"]).select("text", "reps").mapInArrow(lambda it: _cut_out(it, window), "h long, g long, w long, bytes binary"), "suffix-strings")
    built = strings.join(kinds.where("not hot").select("h"), "h").select("h", "g", "w", "bytes").repartition("h").sortWithinPartitions("h", "g")
    spans = built.mapInArrow(lambda it: _transforms(it, window, BUILD_STRINGS), "h long, g long, from long, to long")
    wide = strings.join(kinds.where("hot").select("h"), "h").select("h", "g", "w", "bytes").mapInArrow(lambda it: _windows(it, window), "h long, g long, at long, x long, w long")
    twice = wide.groupBy("h", "x").agg(F.sum("w").alias("n")).where("n > 1").select("h", "x")
    spans = spans.unionByName(wide.join(twice, ["h", "x"]).select("h", "g", F.col("at").alias("from"), (F.col("at") + window).alias("to")))
    spans = cut(spans, "suffix-spans")
    placed = found.join(spans, ["h", "g"]).select("t", v.alias("v"), (start + F.col("from")).alias("from"), (start + F.col("to")).alias("to"))
    return copies.unionByName(placed)


def suffix_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Return (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes), one row for each row of docs.

    Removed is each UTF-8 byte covered by a string of `window` bytes that also starts anywhere else, in the
    same text or another; strings are judged on the input. Null texts are empty, and texts under `window`
    bytes keep all. Repeated rows are documents of their own, so they lose all strings of that length. Ids,
    null or not, take no part: a text is known by 88 bits of digests. Other columns are ignored.

    One transform over a whole corpus would take a round for each byte of its longest text, each reading all
    before it. So the collection is divided first, exactly: each window goes to the least hash of its k-grams,
    equal windows to equal hashes, and runs of windows of one hash are fragments of at most 2 * window bytes.
    Fragments whose hash comes once hold no repeated window; of the others, equal ones become one string with
    a weight (found from digests, before any text moves), and a hash with one string needs no order. The rest,
    the edges of what repeats, goes to tasks by hash, and each builds the column-wise transform and common
    prefixes of its strings in rounds of one symbol a string over sequential files. A hash with more than
    GROUP_STRINGS strings is divided to the end, as by anchors as long as the window: each window is a part of its
    own there, and copies are counted over the cluster, as exactly.
    """
    limit_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    second = F.xxhash64(F.lit("second"), text).bitwiseAND((1 << _V) - 1)
    rows = docs.select("doc_id", F.xxhash64(text).alias("t"), second.alias("v"), text.alias("text"))
    gone = removals(rows.select("t", "v", "text"), window).groupBy("t", "v").agg(F.collect_set(F.struct("from", "to")).alias("spans"))
    out = rows.join(gone, ["t", "v"], "left").select("doc_id", "text", "spans")
    return out.mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir)).drop("kept_bytes")
