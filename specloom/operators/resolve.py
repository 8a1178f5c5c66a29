"""Typed attributes of many products at once: from texts, from pages, from search results; claims with evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specloom.config import DEFAULTS, EngineConfig
from specloom.functions.text import looks_html, page_text
from specloom.functions.values import coerced
from specloom.operators import matching, ranking
from specloom.operators.reconcile import KEYS, lowest_tier, reconcile
from specloom.sources import html


def number_candidates(cands: DataFrame) -> DataFrame:
    """cand_idx by tier, then order in the pool; the first of each (url, value)."""
    first = matching.keep_first(cands, [*KEYS, "url", "value"], "part")
    return first.withColumn("cand_idx", F.row_number().over(Window.partitionBy(*KEYS).orderBy("part", "seq")))


def pool_candidates(attrs: DataFrame, pool: DataFrame, vectors: DataFrame | None = None, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """Tiered candidates: labels alike or meant alike (tier 0), then axes of dimensions (tier 1).

    vectors: (product_id, attr, label) from ann_match, for attributes without a synonym among the labels.
    """
    labels = matching.pool_labels(pool)
    fuzzy = matching.fuzzy_labels(attrs, labels, cfg.pool_match)
    meant = matching.synonym_labels(attrs, labels)
    if vectors is not None:
        more = matching.by_key(matching.by_key(attrs, meant, KEYS, "left_anti"), vectors.withColumnRenamed("attr", "name"), ["product_id", "name"]).select(*KEYS, "label")
        meant = meant.unionByName(more)
    labelled = fuzzy.select(*KEYS, "label", matching.confidence_of(F.col("sim")).alias("confidence"), F.lit(0).alias("part"))
    labelled = labelled.unionByName(meant.select(*KEYS, "label", F.lit(0.80).alias("confidence"), F.lit(1).alias("part")))
    split = matching.dimension_candidates(attrs, pool).withColumns({"tier": F.lit(1), "part": F.lit(2)})
    return number_candidates(lowest_tier(matching.label_candidates(labelled, pool).unionByName(split)))


def assemble(attrs: DataFrame, voted: DataFrame, normalised: DataFrame | None = None) -> DataFrame:
    """(product_id, attr_idx, name, type, value, unit, raw_value, matched_allowed, confidence, source_url, status, sources).

    normalised: (product_id, attr_idx, value, unit, matched, confidence) of a model, for what could not be
    coerced; without one such values pass with half the confidence, numbers and booleans as not found.
    """
    raw = voted.select(*KEYS, F.col("value").alias("raw"), F.col("confidence").alias("vote"), "url", "sources")
    df = coerced(matching.by_key(attrs, raw, KEYS, "left"))
    none = F.lit(None)
    if normalised is None:
        typed = F.col("type").isin("integer", "number", "boolean")
        norm = F.struct(F.when(~typed, F.col("raw")).alias("value"), F.col("unit").alias("unit"), F.lit(False).alias("matched"), F.when(typed, 0.0).otherwise(0.5).alias("confidence"))
        df = df.withColumn("n", norm)
    else:
        df = matching.by_key(df, normalised.select(*KEYS, F.struct("value", "unit", "matched", "confidence").alias("n")), KEYS, "left")
    told, listed = F.coalesce(F.col("raw"), F.lit("")) != "", F.coalesce(F.size("allowed") > 0, F.lit(False))
    done, boost = F.col("coerced").isNotNull(), lambda c, m: F.when(F.coalesce(m, F.lit(False)), F.greatest(c, F.lit(0.85))).otherwise(c)
    status = F.when(~told, "not_found").when(done, "found").when(listed & ~F.coalesce("n.matched", F.lit(False)), "ambiguous").when(F.col("n.value").isNull(), "not_found").otherwise("found")
    df = df.withColumns({"status": status, "_done": done & told})
    pick = lambda f: F.when(F.col("_done"), F.col(f"coerced.{f}")).when(told, F.col(f"n.{f}"))
    conf = boost(F.round(F.col("vote") * pick("confidence"), 4), pick("matched"))
    gone = F.col("status") == "not_found"
    return df.select(
        *KEYS, "name", "type",
        pick("value").alias("value"),
        F.when(told, F.when(F.col("_done"), pick("unit")).otherwise(F.coalesce(pick("unit"), F.col("unit")))).alias("unit"),
        F.when(told, F.col("raw")).alias("raw_value"),
        pick("matched").alias("matched_allowed"),
        F.when(gone, 0.0).otherwise(F.coalesce(conf, F.lit(0.0))).alias("confidence"),
        F.when(gone, none).otherwise(F.col("url")).alias("source_url"),
        "status",
        F.when(gone, none).otherwise(F.col("sources")).alias("sources"),
    )


def resolve_from_pool(attrs: DataFrame, pool: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """attrs (product_id, attr_idx, name, type, unit, allowed) against pool (product_id, seq, name, value, url, title)."""
    return assemble(attrs, reconcile(pool_candidates(attrs, pool, vectors)))


def pool_from_pages(pages: DataFrame) -> DataFrame:
    """pool of (product_id, page_id, page_rank, url, title, html): pages in relevance order."""
    specs = html.extract_specs(pages)
    j = specs.join(pages.select("page_id", "product_id", "page_rank", "url", "title"), "page_id")
    order = Window.partitionBy("product_id").orderBy("page_rank", "page_id", "seq")
    return j.withColumn("seq", F.row_number().over(order).cast("long")).select("product_id", "seq", "page_id", "name", "value", "url", "title")


def productive_pages(specs_per_page: DataFrame, most: int = DEFAULTS.productive_pages) -> DataFrame:
    """(product_id, page_rank, n) in relevance order up to `most` pages with specifications; without any, the first `most`."""
    w = Window.partitionBy("product_id")
    order = w.orderBy("page_rank").rowsBetween(Window.unboundedPreceding, 0)
    has = (F.col("n") > 0).cast("int")
    df = specs_per_page.withColumns({"_k": F.sum(has).over(order), "_any": F.max(has).over(w), "_i": F.row_number().over(w.orderBy("page_rank"))})
    return df.where(((F.col("_any") == 1) & (F.col("n") > 0) & (F.col("_k") <= most)) | ((F.col("_any") == 0) & (F.col("_i") <= most))).drop("_k", "_any", "_i")


def anti_merge(static: DataFrame, rendered: DataFrame, keys: list[str]) -> DataFrame:
    """All of static, and of rendered what static has not by keys."""
    return static.unionByName(rendered.join(static.select(*keys).distinct(), keys, "left_anti"))


def resolve_from_pages(attrs: DataFrame, pages: DataFrame, rendered: DataFrame | None = None) -> DataFrame:
    pool = pool_from_pages(pages)
    if rendered is not None:
        pool = anti_merge(pool, pool_from_pages(rendered), ["product_id", "name", "url"])
    return resolve_from_pool(attrs, pool)


def pool_from_texts(texts: DataFrame) -> DataFrame:
    """pool of (product_id, text): markup goes through the page extractors, the rest line by line."""
    t = texts.withColumns({"text_id": F.col("product_id"), "_html": looks_html(F.col("text"))})
    lines = matching.text_pool(t.where("not _html")).select(F.col("text_id").alias("product_id"), F.col("seq").cast("long").alias("seq"), "name", "value")
    marked = html.extract_specs(t.where("_html").select(F.col("product_id").alias("page_id"), F.col("text").alias("html")))
    marked = marked.select(F.col("page_id").alias("product_id"), F.col("seq").cast("long").alias("seq"), "name", "value")
    return lines.unionByName(marked).withColumns({"url": F.lit("imported-text"), "title": F.lit("")})


def resolve_from_text(attrs: DataFrame, texts: DataFrame) -> DataFrame:
    return resolve_from_pool(attrs, pool_from_texts(texts))


def claims_from_text(texts: DataFrame) -> DataFrame:
    """(text_id, seq, raw_label, raw_value, kind, char_start, char_end, snippet): pairs with the label's first place in the text."""
    pool = pool_from_texts(texts.withColumnRenamed("text_id", "product_id"))
    j = pool.join(texts, pool["product_id"] == texts["text_id"])
    at = F.nullif(F.instr(F.col("text"), F.col("name")), F.lit(0))
    end = F.when(at.isNotNull(), at - 1 + F.length("name"))
    return j.select("text_id", "seq", F.col("name").alias("raw_label"), F.col("value").alias("raw_value"), F.lit("structured").alias("kind"), (at - 1).alias("char_start"), end.alias("char_end"), F.when(at.isNotNull(), F.substring(F.col("text"), at, F.lit(200))).alias("snippet"))


def resolve(products: DataFrame, attrs: DataFrame, results: DataFrame, fetched: DataFrame, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """The whole path: rank results, take each product's best sources, keep relevant pages, pool, match, vote, coerce.

    products (schema of a product), attrs, results (product_id, query_idx, pos, url, title, score), fetched (url, html).
    """
    hints = F.array_compact(F.array(*[F.nullif(F.col(c), F.lit("")) for c in ("name", "article", "mpn")]))
    makers = ranking.official_domains(products).groupBy("product_id").agg(F.collect_set("domain").alias("brand_domains"))
    hinted = products.select("product_id", hints.alias("hints")).join(makers, "product_id", "left")
    best = ranking.top_sources(ranking.rank_sources(ranking.search_scan(results), hinted, ranking.official_site(products, results)), cfg.max_sources)
    pages = best.withColumnRenamed("rank", "page_rank").join(fetched, "url").withColumn("page_id", F.xxhash64("product_id", "url"))
    kept = ranking.keep_relevant(ranking.relevance(products, pages)).drop("page_rank").withColumnRenamed("rank", "page_rank")
    pool = pool_from_pages(kept)
    per = kept.select("product_id", "page_rank", "page_id").join(pool.groupBy("page_id").agg(F.count("*").alias("n")), "page_id", "left").fillna({"n": 0})
    pool = pool.join(productive_pages(per, cfg.productive_pages).select("page_id"), "page_id", "left_semi")
    return resolve_from_pool(attrs, pool.drop("page_id"))


def page_texts(pages: DataFrame) -> DataFrame:
    return pages.withColumn("text", page_text(F.col("html")))
