"""One attribute of a product from everything that was found: the union of extractors, their ladder and its gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom.config import DEFAULTS, EngineConfig
from specloom.functions.similarity import ratio
from specloom.functions.urls import is_safe
from specloom.functions.values import cleaned, display_unit
from specloom.operators import matching, ranking, reconcile
from specloom.operators.reconcile import KEYS
from specloom.operators.resolve import pool_candidates, pool_from_pages
from specloom.sources import replies as models
from specloom.sources import targeted
from specloom.sources.tables import settled

CANDIDATE = ["value", "unit", "confidence", "method", "url", "title", "raw_value"]
#: What a candidate's label has to reach.
ALIKE = 0.75
SNIPPET = 300


def _candidates(df: DataFrame, stage: int, place: list[Column], value: Column, confidence: Column, method: str) -> DataFrame:
    """Rows of one extractor; place orders them within their stage."""
    padded = [*place, *[F.lit(0)] * (4 - len(place))]
    order = F.struct(F.lit(stage).alias("stage"), *[c.cast("long").alias(f"o{i}") for i, c in enumerate(padded)])
    return df.select(*KEYS, order.alias("seq"), value.alias("value"), F.lit(None).cast("string").alias("unit"), confidence.alias("confidence"), F.lit(method).alias("method"), "url", "title", value.alias("raw_value"))


def _attributes(attrs: DataFrame) -> DataFrame:
    return attrs.select(*KEYS, F.col("name").alias("attr"))


def mentions(text: Column, attr: Column) -> Column:
    """Whether a word of the attribute of more than three characters stands in the text."""
    return F.exists(F.split(F.lower(attr), r"\s+"), lambda t: (F.length(t) > 3) & F.contains(F.lower(text), t))


def row_candidates(attrs: DataFrame, pages: DataFrame) -> DataFrame:
    """From rows of pages (product_id, page_id, page_rank, url, title, html): a site's own patterns first, else all tables.

    1.0 from a similarity of 0.95, 0.85 from 0.8, else 0.75.
    """
    rows = targeted.page_rows(pages).join(pages.select("product_id", "page_id", "page_rank", "url", "title"), "page_id")
    j = _attributes(attrs).join(rows, "product_id")
    j = j.join(matching.similar(j, ALIKE), ["label", "attr"])
    first = F.min("kind").over(Window.partitionBy(*KEYS, "page_id"))
    j = j.withColumn("first", first).where("kind = first")
    conf = F.when(F.col("sim") >= 0.95, 1.0).when(F.col("sim") >= 0.8, 0.85).otherwise(0.75)
    return _candidates(j, 1, [F.col("page_rank"), F.lit(1), F.col("seq")], F.col("value"), conf, "css_selector")


def linked_candidates(attrs: DataFrame, pages: DataFrame) -> DataFrame:
    """From linked data: properties alike, 0.9 from 0.85 on, else 0.75; a node without one gives the head of a description that mentions the attribute."""
    rows = targeted.linked_rows(pages).join(pages.select("product_id", "page_id", "page_rank", "url", "title"), "page_id")
    j = _attributes(attrs).join(rows, "product_id")
    pairs = j.where("label is not null").select("label", "attr").distinct()
    sims = pairs.withColumn("sim", ratio(F.trim(F.lower("label")), F.trim(F.lower("attr")))).where(F.col("sim") >= ALIKE)
    named = j.join(sims, ["label", "attr"])
    told = j.where("told is not null").where(mentions(F.col("told"), F.col("attr"))).join(named.select(*KEYS, "page_id", "node").distinct(), [*KEYS, "page_id", "node"], "left_anti")
    place = [F.col("page_rank"), F.lit(0), F.col("node"), F.col("seq")]
    return _candidates(named, 1, place, F.col("value"), F.when(F.col("sim") >= 0.85, 0.9).otherwise(0.75), "jsonld").unionByName(_candidates(told, 1, place, F.substring("told", 1, SNIPPET), F.lit(0.75), "jsonld"))


def box_candidates(attrs: DataFrame, boxes: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """From the search's boxes (product_id, box_idx, url, title, attributes, content) and answers (product_id, pos, answer, url, title)."""
    by_label = matching.infobox_candidates(attrs, boxes)
    named = by_label.select(*KEYS, F.struct(F.lit(0).alias("stage"), F.col("seq.box_idx").cast("long").alias("o0"), F.lit(0).cast("long").alias("o1"), F.col("seq.pos").cast("long").alias("o2"), F.lit(0).cast("long").alias("o3")).alias("seq"), *CANDIDATE)
    j = _attributes(attrs).join(boxes, "product_id").where(mentions(F.coalesce("content", F.lit("")), F.col("attr")))
    out = named.unionByName(_candidates(j, 0, [F.col("box_idx"), F.lit(1)], F.substring("content", 1, SNIPPET), F.lit(0.5), "infobox"))
    if answers is not None:
        told = matching.answer_candidates(attrs, answers).join(answers.select("product_id", F.col("pos").alias("seq"), "url", "title"), ["product_id", "seq"])
        out = out.unionByName(_candidates(told, 0, [F.lit(1 << 20), F.col("seq")], F.col("value"), F.col("confidence"), "infobox"))
    return out


def pipeline_candidates(attrs: DataFrame, pages: DataFrame, boxes: DataFrame | None = None, answers: DataFrame | None = None, replies: DataFrame | None = None, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """All extractors' candidates, in order; a model's only for attributes without one of cfg.model_gate or more, from the first pages.

    replies: (product_id, attr_idx, page_rank, url, title, reply) of a model over pages.
    """
    found = linked_candidates(attrs, pages).unionByName(row_candidates(attrs, pages))
    if boxes is not None:
        found = found.unionByName(box_candidates(attrs, boxes, answers))
    if replies is None:
        return found
    sure = found.where(F.col("confidence") >= cfg.model_gate).select(*KEYS).distinct()
    asked = replies.join(sure, KEYS, "left_anti")
    first = Window.partitionBy(*KEYS).orderBy("page_rank")
    asked = asked.withColumn("_i", F.dense_rank().over(first)).where(F.col("_i") <= cfg.model_pages).drop("_i")
    seq = F.struct(F.lit(2).alias("stage"), F.col("page_rank").cast("long").alias("o0"), *[F.lit(0).cast("long").alias(f"o{i}") for i in (1, 2, 3)])
    return found.unionByName(models.extracted(asked).select(*KEYS, seq.alias("seq"), *CANDIDATE))


def pool_ladder(attrs: DataFrame, pool: DataFrame, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """Candidates of a pool for one attribute at a time: labels alike; only without any, synonyms; only without those, axes."""
    labels = matching.pool_labels(pool)
    fuzzy = matching.fuzzy_labels(attrs, labels, cfg.pool_match).select(*KEYS, "label", matching.confidence_of(F.col("sim")).alias("confidence"), F.lit(0).alias("part"))
    meant = matching.synonym_labels(attrs, labels).select(*KEYS, "label", F.lit(0.80).alias("confidence"), F.lit(1).alias("part"))
    found = matching.label_candidates(fuzzy.unionByName(meant), pool).withColumn("tier", F.col("part"))
    return reconcile.lowest_tier(found.unionByName(matching.dimension_candidates(attrs, pool).withColumns({"tier": F.lit(2), "part": F.lit(2)})))


def together(*parts: DataFrame) -> DataFrame:
    """Candidates of several stages with cand_idx, in the order of the stages and of each one's seq."""
    out = None
    for i, p in enumerate(parts):
        order = Window.partitionBy(*KEYS).orderBy("seq")
        own = p.withColumns({"_p": F.lit(i), "_i": F.row_number().over(order)}).select(*KEYS, "_p", "_i", *CANDIDATE)
        out = own if out is None else out.unionByName(own)
    return out.withColumn("cand_idx", F.row_number().over(Window.partitionBy(*KEYS).orderBy("_p", "_i"))).drop("_p", "_i")


def weighed(attrs: DataFrame, pages: DataFrame, boxes: DataFrame | None, answers: DataFrame | None, replies: DataFrame | None, cfg: EngineConfig) -> DataFrame:
    """Pipeline and pool candidates of relevant pages, their confidences scaled by their page's relevance."""
    pool = settled(pool_from_pages(pages))
    found = together(pipeline_candidates(attrs, pages, boxes, answers, replies, cfg), pool_ladder(attrs, pool, cfg))
    return reconcile.scale_by_page(found, pages.select("product_id", "url", F.col("relevance").alias("weight")).distinct())


def get_attribute(products: DataFrame, attrs: DataFrame, pages: DataFrame, boxes: DataFrame | None = None, answers: DataFrame | None = None, replies: DataFrame | None = None, rendered: DataFrame | None = None, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """(product_id, attr_idx, name, value, unit, confidence, url, n_sources, sources, status) for attrs, one attribute at a time.

    pages (product_id, page_id, page_rank, url, title, html) are the fetched best sources; those of another
    product go, but the best one stays, and they keep the order in which they were fetched. rendered (page_id,
    html) are browser snapshots: where the answer is null or under cfg.weak_result, the first page's snapshot
    joins in, and the new answer counts if there was none or it is surer.
    """
    kept = settled(ranking.keep_relevant(ranking.relevance(products, pages), floor=None).drop("rank"))
    first = settled(weighed(attrs, kept, boxes, answers, replies, cfg))
    voted = settled(attrs.join(reconcile.reconcile(first), KEYS, "left"))
    if rendered is not None:
        weak = voted.where(F.col("value").isNull() | (F.col("confidence") < cfg.weak_result)).select(*attrs.columns)
        head = kept.withColumn("_i", F.row_number().over(Window.partitionBy("product_id").orderBy("page_rank"))).where("_i = 1").drop("_i", "html", "relevance")
        again = settled(ranking.relevance(products, head.join(rendered.select("page_id", "html"), "page_id")))
        late = settled(weighed(weak, again, boxes, answers, None, cfg))
        both = first.join(weak.select(*KEYS), KEYS, "left_semi").withColumn("_p", F.lit(0)).unionByName(late.withColumn("_p", F.lit(1)))
        both = both.withColumn("cand_idx", F.row_number().over(Window.partitionBy(*KEYS).orderBy("_p", "cand_idx"))).drop("_p")
        voted = reconcile.better_of(voted, reconcile.reconcile(both))
    out = cleaned(voted.withColumn("value", F.nullif("value", F.lit(""))), "value", "name", "_clean")
    return out.select(*KEYS, "name", F.coalesce(F.nullif("_clean", F.lit("")), "value").alias("value"), F.coalesce("unit", display_unit(F.col("_clean"))).alias("unit"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "url", "n_sources", "sources", F.when(F.col("value").isNull(), "not_found").otherwise("found").alias("status"))


def rich_pools(pool: DataFrame, productive: DataFrame, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """Products whose pool holds cfg.rich_pool rows or more from two productive pages or more: no search of their own is worth it."""
    rows = pool.groupBy("product_id").agg(F.count("*").alias("n")).where(F.col("n") >= cfg.rich_pool)
    pages = productive.where("n > 0").groupBy("product_id").agg(F.count("*").alias("p")).where("p >= 2")
    return rows.join(pages, "product_id").select("product_id")


def open_queries(queries: DataFrame, most: int = 2) -> DataFrame:
    """The first `most` queries of a product that name no site; where all do, the first of those."""
    keys = ["product_id", *(["attr_idx"] if "attr_idx" in queries.columns else [])]
    order = Window.partitionBy(*keys).orderBy(F.contains("query", F.lit("site:")), "query_idx")
    some = F.max((~F.contains("query", F.lit("site:"))).cast("int")).over(Window.partitionBy(*keys))
    q = queries.withColumns({"_i": F.row_number().over(order), "_open": some})
    return q.where((F.col("_i") <= most) & ((F.col("_open") == 0) | ~F.contains("query", F.lit("site:")))).drop("_i", "_open")


def targeted_candidates(products: DataFrame, missing: DataFrame, results: DataFrame, fetched: DataFrame, rich: DataFrame, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """The last tier: for attributes that nothing answered, of products without a rich pool, the two best pages of a search of their own.

    results are those of open_queries (product_id, query_idx, pos, url, title, score).
    """
    wanted = missing.join(rich, "product_id", "left_anti")
    best = ranking.top_sources(ranking.rank_sources(ranking.search_scan(results)), cfg.targeted_urls)
    pages = best.withColumnRenamed("rank", "page_rank").join(fetched, "url").withColumn("page_id", F.xxhash64("product_id", "url"))
    pages = pages.join(wanted.select("product_id").distinct(), "product_id", "left_semi")
    return pipeline_candidates(wanted, ranking.keep_relevant(ranking.relevance(products, pages)).drop("rank"), cfg=cfg)


def first_answered(attempts: DataFrame, most: int = 2) -> DataFrame:
    """Of up to `most` attempts (product_id, query_idx, attempt, hits array) the first with a hit, else the last."""
    tried = attempts.where(F.col("attempt") < most)
    empty = F.size(F.coalesce("hits", F.array().cast(dict(attempts.dtypes)["hits"]))) <= 0
    order = F.struct(empty.cast("int"), F.when(empty, -F.col("attempt")).otherwise(F.col("attempt")))
    return tried.groupBy("product_id", "query_idx").agg(F.min_by(F.struct("attempt", "hits"), order).alias("a")).select("product_id", "query_idx", "a.*")


def safe_redirects(hops: DataFrame, most: int = 5) -> DataFrame:
    """(fetch_id, url, hops) of fetches (fetch_id, hop, url, from hop 0) that redirect at most `most` times, each time to a safe address."""
    per = hops.groupBy("fetch_id").agg(F.max("hop").alias("hops"), F.bool_and(F.coalesce(is_safe(F.col("url")), F.lit(False))).alias("safe"), F.max_by("url", "hop").alias("url"))
    return per.where(F.col("safe") & (F.col("hops") <= most)).select("fetch_id", "url", "hops")


def product_context(products: DataFrame) -> DataFrame:
    """(product_id, context): what a model is told of a product, a line for each thing known."""
    quoted = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f'{label}: "'), F.col(c), F.lit('"')))
    plain = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{label}: "), F.col(c)))
    lines = [F.concat(F.lit('Product name: "'), F.col("name"), F.lit('"')), quoted("Brand", "brand"), quoted("Category", "category"), quoted("Article/SKU", "article"), plain("EAN-13", "ean13"), plain("UPC", "upc")]
    return products.select("product_id", F.concat_ws("\n", *lines).alias("context"))


def fill_ladder(products: DataFrame, attrs: DataFrame, pool: DataFrame, pages: DataFrame, boxes: DataFrame | None = None, answers: DataFrame | None = None, replies: DataFrame | None = None, targeted_results: DataFrame | None = None, fetched: DataFrame | None = None, productive: DataFrame | None = None, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """Candidates of many attributes, each rung only for what the ones before left empty: the pool, the pipeline over its pages, a search of their own.

    The last rung needs targeted_results and fetched; productive (product_id, page_rank, n) tells which pools are rich.
    """
    cols = [*KEYS, *CANDIDATE, "cand_idx"]
    found = pool_candidates(attrs, pool, cfg=cfg).select(*cols)
    missing = attrs.join(found.select(*KEYS).distinct(), KEYS, "left_anti")
    found = found.unionByName(together(pipeline_candidates(missing, pages, boxes, answers, replies, cfg)).select(*cols))
    if targeted_results is None:
        return found
    missing = missing.join(found.select(*KEYS).distinct(), KEYS, "left_anti")
    rich = rich_pools(pool, productive, cfg) if productive is not None else products.select("product_id").limit(0)
    return found.unionByName(together(targeted_candidates(products, missing, targeted_results, fetched, rich, cfg)).select(*cols))
