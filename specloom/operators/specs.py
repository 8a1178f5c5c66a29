"""All specifications of a product: scoring pages, merging groups, following links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specloom.config import DEFAULTS, EngineConfig


def specs_score(specs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys.., n, groups, score): two points a pair, three a group."""
    per = specs.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("grp").alias("groups"))
    return per.withColumn("score", 2 * F.col("n") + 3 * F.col("groups"))


def merge_groups(specs: DataFrame, top: int = DEFAULTS.merge_top) -> DataFrame:
    """(product_id, grp, seq, name, value): pairs of the `top` best pages, the best page's first of each group and name."""
    ranked = specs.where(F.col("page_rank") <= top)
    first = Window.partitionBy("product_id", "grp", "name").orderBy("page_rank", "seq")
    kept = ranked.withColumn("r", F.row_number().over(first)).where("r = 1")
    order = Window.partitionBy("product_id", "grp").orderBy("page_rank", "seq")
    return kept.withColumn("seq", F.row_number().over(order)).select("product_id", "grp", "seq", "name", "value")


def nested(specs: DataFrame) -> DataFrame:
    """(product_id, groups): array of (name, array of (name, value)), in order."""
    g = specs.groupBy("product_id", "grp").agg(F.sort_array(F.collect_list(F.struct("seq", "name", "value"))).alias("s"))
    inner = F.transform("s", lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))
    return g.groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct(F.col("grp").alias("name"), inner.alias("specs")))).alias("groups"))


def best_variant(scored: DataFrame) -> DataFrame:
    """Of a page's variants (static before rendered) the one that scores more."""
    order = Window.partitionBy("page_id").orderBy(F.col("score").desc(), F.when(F.col("variant") == "static", 0).otherwise(1))
    return scored.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def get_specs(pages: DataFrame, specs: DataFrame, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """Merged pairs of a product's pages (page_id, product_id) and their specs, best scored first."""
    scores = specs_score(specs.join(pages.select("page_id", "product_id", F.col("page_rank").alias("fetched")), "page_id"), ["product_id", "page_id", "fetched"])
    order = Window.partitionBy("product_id").orderBy(F.col("score").desc(), "fetched")
    ranked = scores.withColumn("page_rank", F.row_number().over(order)).select("product_id", "page_id", "page_rank")
    return merge_groups(specs.join(ranked, "page_id"), cfg.merge_top)


def specs_from_url(primary: DataFrame, linked: DataFrame, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """(page_id, source): the first linked page that scores enough, whatever the page itself scores, else the page.

    primary (page_id, score), linked (page_id, link, rank, score).
    """
    good = linked.where(F.col("score") >= cfg.specs_score).groupBy("page_id").agg(F.min_by(F.struct("link", "score"), "rank").alias("g"))
    return primary.join(good, "page_id", "left").select("page_id", F.coalesce("g.link", F.lit("page")).alias("source"), F.coalesce("g.score", "score").alias("score"))


def carry_heading(rows: DataFrame, keys: list[str], order: str, heading: str) -> DataFrame:
    """rows with the last heading up to each, in order."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("grp", F.last(heading, ignorenulls=True).over(w))
