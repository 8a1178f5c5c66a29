"""Ranking sources, relevance of pages, official domains, queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom import catalog
from specloom.config import DEFAULTS, EngineConfig
from specloom.functions.similarity import ratio
from specloom.functions.text import present
from specloom.functions.urls import bare_host, has_model, is_binary, is_support, locale_points, matches_domain, registrable, suffixes


def search_string() -> Column:
    return F.concat_ws(" ", present(F.col("brand")), present(F.col("name")), F.coalesce(present(F.col("article")), present(F.col("mpn"))))


def display_name() -> Column:
    article = present(F.col("article"))
    return F.concat_ws(" ", present(F.col("category")), present(F.col("brand")), present(F.col("name")), F.when(article.isNotNull(), F.concat(F.lit("("), article, F.lit(")"))))


def identifier() -> Column:
    return F.coalesce(*[present(F.col(c)) for c in ("ean13", "upc", "mpn", "article")], search_string())


def search_language(query: Column) -> Column:
    return F.when(query.rlike(r"[\x{0400}-\x{04FF}]"), "all").otherwise("en")


def search_scan(results: DataFrame, most: int = 10) -> DataFrame:
    """The first hits of each query that have an address; the limit comes first."""
    return results.where(F.col("pos") < most).where(F.coalesce(F.col("url"), F.lit("")) != "")


def domain_points(urls: DataFrame) -> DataFrame:
    """(url, points): of the known domains at or above the host, good ones before useless ones."""
    spark = urls.sparkSession
    up = urls.select("url").distinct().select("url", F.explode(suffixes(bare_host(F.col("url")))).alias("domain"))
    return up.join(F.broadcast(catalog.domains(spark)), "domain").groupBy("url").agg(F.min_by("points", F.struct("kind", -F.length("domain"))).alias("points"))


def rank_sources(results: DataFrame, products: DataFrame | None = None, official: DataFrame | None = None) -> DataFrame:
    """(product_id, url, title, total, rank) of (product_id, query_idx, pos, url, title, score).

    A hit gives its distance from the end of its list and its own score; further points go to repeated hits,
    good domains, the maker's (products: product_id, hints; brand_domains array) and official domain, models
    in the address, and wanted locales, and are taken for service pages. Equal totals keep first sight.
    """
    n = F.count("*").over(Window.partitionBy("product_id", "query_idx"))
    hits = results.withColumn("gain", n - F.col("pos") + F.coalesce("score", F.lit(0.0))).where(~is_binary(F.col("url")))
    seen = F.struct("query_idx", "pos")
    per = hits.groupBy("product_id", "url").agg(F.sum("gain").alias("gain"), F.count("*").alias("hits"), F.min(seen).alias("seen"), F.min_by("title", F.when(F.coalesce(F.col("title"), F.lit("")) != "", seen)).alias("title"))
    per = per.join(domain_points(hits), "url", "left")
    total = F.col("gain") + 1.5 * (F.col("hits") - 1) + F.coalesce("points", F.lit(0.0)) + locale_points(F.col("url")) - F.when(is_support(F.col("url")), 12.0).otherwise(0.0)
    if products is not None:
        per = per.join(products.select("product_id", "hints", "brand_domains"), "product_id", "left")
        maker = F.exists(F.coalesce("brand_domains", F.array().cast("array<string>")), lambda d: matches_domain(F.col("url"), d))
        total = total + F.when(maker, 12.0).otherwise(0.0) + F.when(has_model(F.col("url"), F.coalesce("hints", F.array().cast("array<string>"))), 8.0).otherwise(0.0)
    if official is not None:
        per = per.join(official.select("product_id", F.col("domain").alias("official")), "product_id", "left")
        total = total + F.when(matches_domain(F.col("url"), F.col("official")), 20.0).otherwise(0.0)
    return ranked(per.withColumn("total", total), ["product_id"], "seen").select("product_id", "url", F.coalesce("title", F.lit("")).alias("title"), "total", "rank")


def ranked(df: DataFrame, keys: list[str], seen: str) -> DataFrame:
    """df with its rank by total within keys; equal totals keep the order of `seen`."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("total").desc(), seen)))


def top_sources(ranked: DataFrame, k: int = DEFAULTS.max_sources) -> DataFrame:
    return ranked.where(F.col("rank") <= k)


def brand_key(c: Column) -> Column:
    s = F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\w\s'-]", " "), r"(?U)\s+", " "))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in catalog.CYRILLIC_BRANDS.items() for x in kv]), s), s)


def official_domains(products: DataFrame) -> DataFrame:
    """(product_id, domain, pos): the maker's domains by the brand, else by its first word."""
    table = F.broadcast(catalog.brands(products.sparkSession))
    keys = products.select("product_id", brand_key(F.col("brand")).alias("k"))
    keys = keys.select("product_id", F.explode(F.array_distinct(F.array("k", F.substring_index("k", " ", 1)))).alias("brand"), F.col("k"))
    found = keys.join(table, "brand").withColumn("own", (F.col("brand") == F.col("k")).cast("int"))
    best = Window.partitionBy("product_id")
    return found.withColumn("top", F.max("own").over(best)).where("own = top").select("product_id", "domain", "pos")


GENERIC = "the and for gaming series pro max plus mini ultra lite air new gen edition".split()


def brand_hint() -> Column:
    """The brand, else the name's ASCII words up to the first model number, else the name."""
    ascii_words = F.filter(F.split("name", r"\s+"), lambda t: t.rlike(r"^[\x00-\x7F]+$"))
    model = F.array_position(F.transform(ascii_words, lambda t: t.rlike(r"^[A-Za-z]{0,3}[0-9]{3,}")), True)
    head = F.array_join(F.when(model > 0, F.slice(ascii_words, F.lit(1), model.cast("int"))).otherwise(ascii_words), " ")
    return F.coalesce(present(F.col("brand")), present(head), F.col("name"))


def looks_official(domain: Column, hint: Column) -> Column:
    t = F.filter(F.split(F.lower(hint), r"\s+"), lambda x: x.rlike(r"^[\x21-\x7F]{2,}$") & ~x.isin(*GENERIC))
    return (F.size(t) == 0) | F.exists(t, lambda x: F.contains(domain, x))


def official_site(products: DataFrame, results: DataFrame) -> DataFrame:
    """(product_id, domain): from the table of makers, else the first result whose domain bears the brand."""
    known = official_domains(products).where("pos = 0").select("product_id", "domain")
    hinted = products.join(known, "product_id", "left_anti").select("product_id", brand_hint().alias("hint"))
    hits = results.select("product_id", "query_idx", "pos", registrable(F.col("url")).alias("domain")).join(hinted, "product_id")
    found = hits.where(F.col("domain").isNotNull() & looks_official(F.col("domain"), F.col("hint"))).groupBy("product_id").agg(F.min_by("domain", F.struct("query_idx", "pos")).alias("domain"))
    return known.unionByName(found)


def query_templates(products: DataFrame, attribute: str | None = None) -> DataFrame:
    """(product_id, query_idx, query): at most three queries, the maker's site and bar codes first, none twice."""
    makers = official_domains(products).where("pos = 0").select("product_id", "domain")
    s, code = search_string(), F.coalesce(present(F.col("ean13")), present(F.col("upc")))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    if attribute:
        made = [F.concat(F.lit("site:"), "domain", F.lit(" "), "name"), F.concat(quoted(code), F.lit(f" {attribute} specifications")), F.concat(quoted(s), F.lit(f" {attribute} specifications")), F.concat(s, F.lit(f" specifications {attribute}"))]
    else:
        made = [F.concat(quoted(code), F.lit(" specifications")), F.concat(s, F.lit(" specifications")), F.concat(s, F.lit(" характеристики"))]
    q = products.join(makers, "product_id", "left").select("product_id", F.transform(F.array_compact(F.array(*made)), lambda x: F.trim(x)).alias("all"))
    q = q.select("product_id", F.posexplode("all").alias("i", "query")).where("query <> ''")
    first = q.withColumn("r", F.row_number().over(Window.partitionBy("product_id", F.lower("query")).orderBy("i"))).where("r = 1")
    return first.withColumn("query_idx", F.row_number().over(Window.partitionBy("product_id").orderBy("i")) - 1).where("query_idx < 3").select("product_id", "query_idx", "query")


#: Shops with uniform tables of specifications.
SHOPS = "site:hotline.ua OR site:rozetka.com.ua OR site:ek.ua"


def spec_queries(products: DataFrame, official: DataFrame | None = None, most: int = 4) -> DataFrame:
    """(product_id, query_idx, query) for all specifications: the maker's site, bar code, both languages, shops; none twice, `most` at most.

    official (product_id, domain) keeps to that site: its pages of the name, then of specifications.
    """
    s, code = search_string(), F.coalesce(present(F.col("ean13")), present(F.col("upc")))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    makers = official_domains(products).where("pos = 0").select("product_id", F.col("domain").alias("maker"))
    p = products.join(makers, "product_id", "left")
    p = p.join(official.select("product_id", "domain"), "product_id", "left") if official is not None else p.withColumn("domain", F.lit(None).cast("string"))
    own = F.concat(F.lit("site:"), "domain", F.lit(" "))
    at_site = F.array(F.concat(own, quoted(F.col("name"))), F.concat(own, s, F.lit(" specifications")))
    open_ = F.array(F.concat(F.lit("site:"), "maker", F.lit(" "), "name"), F.concat(quoted(code), F.lit(" specifications")), F.concat(s, F.lit(" specifications")), F.concat(s, F.lit(" характеристики")), F.concat(s, F.lit(f" {SHOPS}")))
    made = F.transform(F.array_compact(F.when(F.col("domain").isNotNull(), at_site).otherwise(open_)), F.trim)
    q = p.select("product_id", F.posexplode(made).alias("i", "query")).where("query <> ''")
    first = q.withColumn("r", F.row_number().over(Window.partitionBy("product_id", F.lower("query")).orderBy("i"))).where("r = 1")
    return first.withColumn("query_idx", F.row_number().over(Window.partitionBy("product_id").orderBy("i")) - 1).where(F.col("query_idx") < most).select("product_id", "query_idx", "query")


def _tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+(?:-[a-z0-9]+)*"), F.lit(0))


def _alnum(t: Column) -> Column:
    return F.regexp_replace(t, "[^a-z0-9]", "")


def relevance_parts(df: DataFrame) -> DataFrame:
    """Add coverage, extra models and the digit gate of (name, search, title)."""
    df = df.withColumns({"_tt": F.array_distinct(_tokens(F.coalesce("title", F.lit("")))), "_qt": F.array_distinct(_tokens(F.col("search"))), "_nt": F.filter(_tokens(F.col("name")), lambda t: F.length(t) > 1)})
    df = df.withColumns({"_ta": F.filter(F.transform("_tt", _alnum), lambda x: F.length(x) >= 4), "_qa": F.filter(F.transform("_qt", _alnum), lambda x: F.length(x) >= 3)})
    either = lambda a, b: F.contains(a, b) | F.contains(b, a)
    covered = lambda t: F.array_contains("_tt", t) | ((F.length(_alnum(t)) >= 4) & F.exists("_ta", lambda x: either(x, _alnum(t))))
    model = lambda t: t.rlike("[a-z]") & t.rlike(r"\d")
    respelled = lambda t: (F.length(_alnum(t)) >= 3) & F.exists("_qa", lambda q: either(q, _alnum(t)))
    runs = lambda c: F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\d+"), F.lit(0))
    a, b = runs(F.col("name")), runs(F.col("title"))
    return df.withColumns({
        "coverage": F.when(F.size("_nt") > 0, F.size(F.filter("_nt", covered)) / F.size("_nt")).otherwise(0.0),
        "extra_models": F.size(F.filter("_tt", lambda t: model(t) & ~F.array_contains("_qt", t) & ~respelled(t))),
        "other_digits": (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b),
    }).drop("_tt", "_qt", "_nt", "_ta", "_qa")


def relevance(products: DataFrame, pages: DataFrame) -> DataFrame:
    """pages with `relevance` in [0, 1]: 1 where an identifier stands in the page, else by names, models and digits."""
    p = products.withColumn("search", search_string()).select("product_id", "name", "search", F.array_compact(F.array(*[present(F.col(c)) for c in ("ean13", "upc", "mpn", "article")])).alias("ids"))
    df = relevance_parts(pages.join(p, "product_id")).withColumn("_fuzzy", ratio(F.lower("search"), F.lower(F.coalesce("title", F.lit("")))))
    score = F.greatest(F.col("coverage"), 0.6 * F.col("_fuzzy")) - 0.25 * F.col("extra_models")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.col("other_digits"), F.least(score, F.lit(0.25))).otherwise(score)))
    hit = F.exists("ids", lambda i: F.contains(F.lower("html"), F.lower(i)))
    return df.withColumn("relevance", F.when(hit, 1.0).otherwise(score)).select(*pages.columns, "relevance")


def keep_relevant(scored: DataFrame, top: int | None = None, floor: float | None = DEFAULTS.fallback_floor, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """Pages at the relevance floor or above, else each product's single best at `floor` (None: any); rank by relevance."""
    order = Window.partitionBy("product_id").orderBy(F.col("relevance").desc(), "page_rank")
    best = F.max("relevance").over(Window.partitionBy("product_id"))
    df = scored.withColumns({"rank": F.row_number().over(order), "best": best})
    spare = (F.col("best") < cfg.relevance_floor) & (F.col("rank") == 1) & (F.col("relevance") >= (floor if floor is not None else -1.0))
    df = df.where((F.col("relevance") >= cfg.relevance_floor) | spare).drop("best")
    return df if top is None else df.where(F.col("rank") <= top)
