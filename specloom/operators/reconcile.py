"""Conflicting candidates to one value by weighted vote, with provenance."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom import catalog
from specloom.config import DEFAULTS
from specloom.functions.similarity import ratio_of
from specloom.functions.urls import host

KEYS = ["product_id", "attr_idx"]


def _map(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def weight(method: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(catalog.METHOD_WEIGHT), method), F.lit(0.5))


def single_factor(method: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(catalog.SINGLE_SOURCE), method), F.lit(0.85))


def value_key(c: Column) -> Column:
    return F.btrim(F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " "))), F.lit(".,;:"))


def site(url: Column) -> Column:
    """The host; pseudo addresses of the search itself are sites of their own."""
    return F.when(url.startswith("searxng://"), url).otherwise(F.coalesce(host(url), F.lower(url)))


def in_order(points: Column) -> Column:
    """The sum of (cand_idx, points) in the order of candidates: the same double however the rows are dealt out."""
    return F.aggregate(F.sort_array(points), F.lit(0.0), lambda s, x: s + F.coalesce(x["points"], F.lit(0.0)))


def half_up(c: Column, places: int) -> Column:
    """Rounded as SQL rounds a double: by its product with a power of ten, not by its shortest digits (0.30015 is under its half)."""
    return F.floor(c * 10.0**places + 0.5) / 10.0**places


#: What is told of each source of an answer.
SOURCE = ("cand_idx", "url", "title", "method", "confidence", "raw_value", "unit")


def by_value(cands: DataFrame) -> DataFrame:
    """One row for each distinct value of (product_id, attr_idx): key, first sight, points of each candidate, best member, sites, members, who said it."""
    best = F.struct(F.col("confidence"), -F.col("cand_idx"))
    return cands.groupBy(*KEYS, value_key(F.col("value")).alias("key")).agg(
        F.min("cand_idx").alias("first"),
        F.collect_list(F.struct("cand_idx", (F.col("confidence") * weight(F.col("method"))).alias("points"))).alias("points"),
        F.max_by(F.struct("confidence", (-F.col("cand_idx")).alias("order"), "value", "unit", "method", "url"), best).alias("best"),
        F.collect_set(site(F.col("url"))).alias("sites"),
        F.count("*").alias("members"),
        F.collect_list(F.struct("value", *SOURCE)).alias("said"),
    )


def greedy(threshold: float) -> Callable[[Column], Column]:
    """The cluster of each value of an array: the first whose first value is alike, else a new one."""

    def one(keys: Iterable[str]) -> list[int]:
        heads: list[str] = []
        out = []
        for k in keys:
            at = next((i for i, h in enumerate(heads) if ratio_of(k, h) >= threshold), len(heads))
            if at == len(heads):
                heads.append(k)
            out.append(at)
        return out

    return F.pandas_udf(lambda v: pd.Series([one(x) if len(x) > 1 else [0] for x in v]), "array<int>")


def alike(values: DataFrame, threshold: float = DEFAULTS.cluster) -> DataFrame:
    """values (distinct ones, as of by_value) with the cluster of each, in order of first sight; a group meets Python as one array of its distinct values."""
    row = [c for c in values.columns if c not in (*KEYS, "first")]
    g = values.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("first", *row))).alias("v"))
    g = g.withColumn("cluster", greedy(threshold)(F.transform("v", lambda x: x["key"])))
    return g.select(*KEYS, F.explode(F.arrays_zip("v", "cluster")).alias("x")).select(*KEYS, "x.v.*", "x.cluster")


def equal(values: DataFrame) -> DataFrame:
    """values of by_value, each a cluster of its own, numbered by first sight: a plan without Python."""
    return values.withColumn("cluster", F.row_number().over(Window.partitionBy(*KEYS).orderBy("first")) - 1)


def clusters(cands: DataFrame, threshold: float = DEFAULTS.cluster) -> DataFrame:
    """(product_id, attr_idx, key, cluster): each distinct value joins the first cluster whose first value is alike."""
    first = cands.groupBy(*KEYS, value_key(F.col("value")).alias("key")).agg(F.min("cand_idx").alias("first"))
    return alike(first, threshold).select(*KEYS, "key", "cluster")


def vote(values: DataFrame) -> DataFrame:
    """(product_id, attr_idx, value, unit, confidence, url, n_sources, sources) from values with their clusters.

    The cluster of most confidence times method weight wins, the earlier one among equals. Its share of all,
    less a quarter where the next has 0.7 of it, and no more than its best member's confidence, gains 15 % up
    to 0.97 from two sites or more, else is scaled for its method. Rounded half up to four places. Sums are
    taken in the order of candidates and of ranks; clusters are equal that are so to nine places.
    """
    per = values.groupBy(*KEYS, "cluster").agg(
        in_order(F.flatten(F.collect_list("points"))).alias("score"),
        F.max("best").alias("b"),
        F.size(F.array_distinct(F.flatten(F.collect_list("sites")))).alias("sites"),
        F.sum("members").alias("members"),
        F.flatten(F.collect_list("said")).alias("said"),
    )
    group = Window.partitionBy(*KEYS)
    order = group.orderBy(F.round("score", 9).desc(), "cluster")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumns({"r": F.row_number().over(order), "next": F.lead("score").over(order), "total": F.sum("score").over(whole), "n_sources": F.sum("members").over(group)}).where("r = 1")
    base = F.when(F.col("total") > 0, F.col("score") / F.col("total")).otherwise(0.0)
    base = base * F.when(F.col("next") >= 0.7 * F.col("score"), 0.75).otherwise(1.0)
    base = F.least(base, F.col("b.confidence"))
    conf = F.when(F.col("sites") >= 2, F.least(F.lit(0.97), base * 1.15)).otherwise(base * single_factor(F.col("b.method")))
    told = F.transform(F.filter("said", lambda s: s["value"] == F.col("b.value")), lambda s: F.struct(*[s[c].alias(c) for c in SOURCE]))
    return per.select(*KEYS, "b.value", "b.unit", half_up(conf, 4).alias("confidence"), "b.url", "n_sources", F.sort_array(told).alias("sources"))


def reconcile(cands: DataFrame) -> DataFrame:
    return vote(alike(by_value(cands)))


def scale_by_page(cands: DataFrame, weights: DataFrame) -> DataFrame:
    """Confidences times the weight of their page (1 where it has none), rounded to four places where it is under 0.999."""
    j = cands.join(weights.select("product_id", "url", F.col("weight").alias("_w")), ["product_id", "url"], "left").withColumn("_w", F.coalesce("_w", F.lit(1.0)))
    return j.withColumn("confidence", F.when(F.col("_w") < 0.999, F.round(F.col("confidence") * F.col("_w"), 4)).otherwise(F.col("confidence"))).drop("_w")


def lowest_tier(cands: DataFrame) -> DataFrame:
    """Of tiers of candidates (0 first) only the first that has any, for each attribute."""
    return cands.withColumn("_t", F.min("tier").over(Window.partitionBy(*KEYS))).where("tier = _t").drop("_t")


def better_of(old: DataFrame, new: DataFrame) -> DataFrame:
    """The new answer where there was none or its confidence is higher, else the old one."""
    cols = [c for c in ("value", "unit", "confidence", "url", "n_sources", "sources") if c in old.columns]
    n = new.select(*KEYS, F.struct(*cols).alias("n"))
    j = old.join(n, KEYS, "left")
    take = F.col("n.value").isNotNull() & (F.col("value").isNull() | (F.col("n.confidence") > F.col("confidence")))
    return j.select(*[F.when(take, F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in old.columns])
