"""Near-duplicates by min-max hashing: minimum and maximum under each permutation, banded, confirmed on full sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specloom.llm.common import components, cut, documents, lean, limit_batches, mix, shingle_sets

#: A band is the minima and maxima of PER_BAND permutations, eight values. At a similarity of 0.8 all eight
#: agree with probability 0.17, so that a pair shares none of 64 bands with probability 8e-6; at 0.2, which long
#: texts of one language reach, they agree with 3e-6.
BANDS, PER_BAND = 64, 4
#: Documents named in a broadcast filter of the texts, about 32 bytes each; beyond it the texts shuffle.
BROADCAST_IDS = 500_000
FEATURES = "doc_id long, n_shingles long, set_id binary, bands array<long>"


def _permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, n, np.uint64), rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def min_max_bands(sets: list[np.ndarray], bands: int = BANDS, per_band: int = PER_BAND, seed: int = 11) -> np.ndarray:
    """One row of band keys for each set, none of them empty: each hash evaluation serves a minimum and a maximum."""
    keys = np.zeros((len(sets), bands), np.uint64)
    if not sets:
        return keys
    flat, at = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    xors, factors = _permutations(bands * per_band, seed)
    with np.errstate(over="ignore"):
        for b in range(bands):
            key = np.full(len(sets), b + 1, np.uint64)
            for p in range(b * per_band, (b + 1) * per_band):
                v = (flat ^ xors[p]) * factors[p]
                for end in (np.minimum.reduceat(v, at), np.maximum.reduceat(v, at)):
                    key = mix(key * np.uint64(0x9FB21C651E98DF25) + end)
            keys[:, b] = key
    return keys


@lean
def _features(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = shingle_sets(b.column("text"), k)
        full = [i for i, s in enumerate(sets) if len(s)]
        keys = min_max_bands([sets[i] for i in full])
        per = np.zeros(len(sets), np.int32)
        per[full] = BANDS
        bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]).astype(np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
        ids = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(ids, pa.binary()), bands], ["doc_id", "n_shingles", "set_id", "bands"])


@lean
def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = shingle_sets(b.column("text"), k)
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32)), pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)))
        ids = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) for s in sets]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.int64()), lists], ["rep", "s", "shingles"])


def full_sets(texts: DataFrame, nodes: DataFrame, k: int, broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """(rep, s, shingles) of the documents of nodes (rep), one row for each different set; s names the set."""
    nodes = cut(nodes, "near-dup-nodes")
    few = nodes.count() <= broadcast_ids
    nodes = nodes.select(F.col("rep").alias("doc_id"))
    named = texts.join(F.broadcast(nodes) if few else nodes, "doc_id", "left_semi")
    sets = named.mapInArrow(lambda it: _sets(it, k), "rep long, s long, shingles array<long>")
    return cut(sets.groupBy("rep", "s").agg(F.first("shingles").alias("shingles")), "near-dup-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of pairs whose full sets have 100 * intersection >= percent * union."""
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb")), "b")
    both = both.select("a", "b", (F.size("sa") + F.size("sb")).alias("sum"), F.size(F.array_intersect("sa", "sb")).alias("inter"))
    return cut(both.where(100 * F.col("inter") >= percent * (F.col("sum") - F.col("inter"))).select("a", "b").distinct(), "near-dup-links")


def _fits(m: str, n: str, percent: int) -> Column:
    return 100 * F.least(m, n) >= percent * F.greatest(m, n)


def _apart(rows: DataFrame, root: DataFrame) -> DataFrame:
    """(rep, root) of the documents in buckets whose members are in several components so far."""
    at = rows.join(root.select(F.col("node").alias("rep"), F.col("root").alias("r")), "rep", "left").select("key", "rep", F.coalesce("r", "rep").alias("root"))
    several = at.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
    return at.join(several, "key", "left_semi").select("rep", "root").distinct()


def _crossing(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components among `apart` (rep, root) that can still reach percent; none that does is left out.

    Each set is ordered rarest shingle first. Where two sets first agree, at places i and j from 0, they have
    at most least(n - i, m - j) shingles in common, and for a link that has to be percent / (100 + percent) of
    n + m. So only the first (100 - percent) in 100 shingles of a set, and one more, are compared, and copies
    varied on their own hold there what few others hold. A shingle held by one component alone is left out,
    and the members of the component that holds most of one are not compared with one another.
    """
    shingles = sets.join(apart, "rep").select("rep", "s", "root", F.size("shingles").alias("n"), F.explode("shingles").alias("h"))
    held = shingles.groupBy("h").agg(F.count("*").alias("df"))
    order = Window.partitionBy("rep", "s").orderBy("df", "h")
    ranked = shingles.join(held, "h").withColumn("i", F.dense_rank().over(order) - 1)
    first = cut(ranked.where(100 * F.col("i") <= (100 - percent) * F.col("n")).where("df > 1").select("h", "rep", "n", "i", "root"), "near-dup-first")
    roots = first.groupBy("h", "root").agg(F.count("*").alias("c")).groupBy("h").agg(F.max_by("root", F.struct("c", -F.col("root"))).alias("main"), F.count("*").alias("roots"))
    open_ = cut(first.join(roots.where("roots > 1").select("h", "main"), "h"), "near-dup-open")
    x, y = open_.where("root != main").alias("x"), open_.alias("y")
    met = x.join(y, "h").where("x.root != y.root and (y.root = y.main or x.rep < y.rep)").where(_fits("x.n", "y.n", percent))
    met = met.where((100 + percent) * F.least(F.col("x.n") - F.col("x.i"), F.col("y.n") - F.col("y.i")) >= percent * (F.col("x.n") + F.col("y.n")))
    return met.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def near_dup(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Return (doc_id, n_shingles, component_id, kept), one row for each row of docs.

    Documents whose sets of k-word shingles have 100 * intersection >= percent * union are linked;
    component_id is the smallest doc_id that links reach, kept says whether that is the document itself.
    Null and empty texts have no shingles and, like null ids (component_id null, kept), are linked with
    nothing. Rows with one doc_id are one document. Other columns are ignored.

    1. Documents with equal sets form a class, found by a partial aggregate over digests; its smallest id
       stands for it, so copies never meet in pairs.
    2. Min-max hash bands deal the classes into buckets. A document's weight is the sum of the sizes of its
       buckets: the text that others were varied from meets more of them than they meet one another. The
       member of most weight is its bucket's centre, and each other member is compared with it alone.
    3. Documents in buckets that the confirmed links leave in several components are compared across
       components, where the rarest of their shingles leave a link possible: no link between candidates is
       lost, and a bucket of texts that are alike, linked or not, costs about its size.
    4. Components of the links, over classes and then documents.
    Each set moves once, for the documents that share a bucket.
    """
    limit_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    features = cut(texts.mapInArrow(lambda it: _features(it, k), FEATURES), "near-dup-features")
    full = features.where("set_id is not null and doc_id is not null")
    classes = full.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    members = classes.select("rep", "n", F.explode("bands").alias("key"))
    sizes = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = cut(members.hint("merge").join(sizes, "key"), "near-dup-buckets")
    weighed = shared.join(shared.groupBy("rep").agg(F.sum("size").alias("weight")), "rep").select("key", "rep", "n", "weight")
    centres = weighed.groupBy("key").agg(F.max_by(F.struct("rep", "n"), F.struct("weight", -F.col("rep"))).alias("c"))
    stars = weighed.join(centres, "key").where(F.col("rep") != F.col("c.rep")).where(_fits("n", "c.n", percent))
    stars = cut(stars.select(F.least("c.rep", "rep").alias("a"), F.greatest("c.rep", "rep").alias("b")).distinct(), "near-dup-stars")
    sets = full_sets(texts, shared.select("rep").distinct(), k)
    links = _confirmed(stars, sets, percent)
    apart = cut(_apart(shared.select("key", "rep"), components(links)), "near-dup-apart")
    more = _confirmed(_crossing(apart, sets, percent), sets, percent)
    several = full.groupBy("doc_id").agg(F.min("set_id").alias("x"), F.max("set_id").alias("y")).where("x != y").select("doc_id")
    same_doc = full.join(several, "doc_id").join(classes.select("set_id", "rep"), "set_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).distinct()
    root = components(links.unionByName(more).unionByName(same_doc))
    reach = classes.select("set_id", "rep").join(root.select(F.col("node").alias("rep"), "root"), "rep", "left").select("set_id", F.coalesce("root", "rep").alias("root"))
    out = features.select("doc_id", "n_shingles", "set_id").join(reach, "set_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup(documents(spark, sf_dir), k=2)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
         ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (
  SELECT DISTINCT doc_id, doc_id AS seen FROM documents
  UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.seen = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
JOIN (SELECT doc_id, min(seen) AS c FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""
