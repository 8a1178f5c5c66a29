"""One query for each operator over the driver's tables, with DuckDB SQL beside it where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specloom.config import EngineConfig
from specloom.functions import quantity, text, urls, values
from specloom.functions.similarity import core_tokens, label_similarity
from specloom.operators import matching, ranking, reconcile, resolve, specs
from specloom.sources import html
from specloom.streaming import stateful

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        name = f"q_{f.__name__}"
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def part_pool(spark: SparkSession, d: str) -> DataFrame:
    """part as a pool: four labelled values a product."""
    p = table(spark, d, "part")
    pairs = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(n).alias("name"), F.col(c).cast("string").alias("value")) for i, (n, c) in enumerate((("Brand", "p_brand"), ("Product type", "p_type"), ("Size, mm", "p_size"), ("Name", "p_name")))])
    rows = p.select(F.col("p_partkey").alias("product_id"), F.explode(pairs).alias("x"))
    return rows.select("product_id", F.col("x.seq").cast("long").alias("seq"), F.col("x.name").alias("name"), F.col("x.value").alias("value"), F.concat(F.lit("https://shop.example/"), F.col("product_id").cast("string")).alias("url"), F.lit("").alias("title"))


def part_attrs(spark: SparkSession, d: str) -> DataFrame:
    rows = (("Size", "number", "cm", None), ("Type", "string", None, None), ("Brand", "string", None, None), ("Weight", "number", "kg", None))
    attrs = F.array(*[F.struct(F.lit(i).alias("attr_idx"), F.lit(n).alias("name"), F.lit(t).alias("type"), F.lit(u).cast("string").alias("unit"), F.lit(a).cast("array<string>").alias("allowed")) for i, (n, t, u, a) in enumerate(rows)])
    return table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.explode(attrs).alias("a")).select("product_id", "a.*")


@query("""
SELECT p_partkey AS product_id, 0::BIGINT AS seq, 'Brand' AS name, p_brand AS value FROM part
UNION ALL SELECT p_partkey, 1, 'Product type', p_type FROM part
UNION ALL SELECT p_partkey, 2, 'Size, mm', p_size::VARCHAR FROM part
UNION ALL SELECT p_partkey, 3, 'Name', p_name FROM part""")
def pool_unpivot(spark: SparkSession, d: str) -> DataFrame:
    return part_pool(spark, d).select("product_id", "seq", "name", "value")


@query("""
SELECT doc_id, count(*)::BIGINT AS cells FROM (
  SELECT doc_id, unnest(string_split(line, ' | ')) AS cell
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))
WHERE cell <> '' GROUP BY doc_id""")
def text_cells(spark: SparkSession, d: str) -> DataFrame:
    cells = table(spark, d, "documents").select("doc_id", F.explode(text.text_cells(F.col("text"))).alias("cell"))
    return cells.where("cell <> ''").groupBy("doc_id").agg(F.count("*").alias("cells"))


@query("""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS t FROM documents),
n AS (SELECT doc_id, t, list_filter(t, lambda x: regexp_full_match(x, '-?[0-9]+([.,][0-9]+)?')) AS n FROM t)
SELECT doc_id, len(t) >= 8 AND len(n) >= 5 AND len(list_distinct(list_transform(
  list_filter(t, lambda x: NOT regexp_full_match(x, '-?[0-9]+([.,][0-9]+)?')), lambda x: trim(lower(x), '.,;:()')))) <= 2 AS facet FROM n""")
def facet_like(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.facet_like(F.col("text")).alias("facet"))


@query("SELECT page_id, nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '') AS title, strlen(html) <= 3000000 AS fits FROM pages")
def page_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.nullif(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1), F.lit("")).alias("title"), text.within_size(F.col("html")).alias("fits"))


@query()
def page_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.page_text(F.col("html")).alias("text"))


@query()
def page_links(spark: SparkSession, d: str) -> DataFrame:
    return html.links(table(spark, d, "pages")).drop("self")


@query("""
SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host,
  regexp_matches(lower(split_part(url, '?', 1)), '\\.(pdf|jpg|jpeg|png|webp|gif|zip|rar|doc|docx|xls|xlsx|mp4|exe)$') AS skipped,
  regexp_matches(url, '(?i)^https?://') AS web
FROM pages""")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.host(u).alias("host"), urls.is_binary(u).alias("skipped"), u.rlike("(?i)^https?://").alias("web"))


@query()
def url_safe(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.is_safe(F.col("url")).alias("safe"))


@query("""
WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '') AS h FROM pages),
p AS (SELECT page_id, h, string_split(h, '.') AS p FROM h)
SELECT page_id, CASE WHEN len(p) <= 2 THEN h WHEN length(p[-2]) <= 3 THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain
FROM p""")
def url_domain(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.registrable(F.col("url")).alias("domain"))


@query("""
WITH s AS (SELECT page_id, url, regexp_extract(url, '^(?:[^/]*//)?[^/]*(/.*)$', 1) AS path FROM pages),
m AS (SELECT *, regexp_extract(path, '(?i)/([a-z]{2})[-_]([a-z]{2})(/|$)', 1) AS a, regexp_extract(path, '(?i)/([a-z]{2})[-_]([a-z]{2})(/|$)', 2) AS b FROM s)
SELECT page_id, CASE WHEN a <> '' AND (lower(a) IN ('en','uk','ua') OR lower(b) IN ('en','uk','ua')) THEN 4.0 WHEN a <> '' THEN -4.0
  WHEN regexp_matches(url, '(?i)/(ua|uk|en)(/|$)|[?&]lang=(en|uk|ua)') THEN 4.0 ELSE 0.0 END::DOUBLE AS points FROM m""")
def locale_points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.locale_points(F.col("url")).alias("points"))


def _results(spark: SparkSession, d: str) -> DataFrame:
    """pages as the answers to ten queries: a page is a hit of the query of its number's last digit, in order."""
    p = table(spark, d, "pages").select("page_id", "url").withColumns({"query_idx": (F.col("page_id") % 10).cast("int"), "url": F.regexp_replace("url", r"[?#].*$", "")})
    order = Window.partitionBy("query_idx").orderBy("page_id")
    return p.select(F.lit(1).cast("long").alias("product_id"), "query_idx", (F.row_number().over(order) - 1).alias("pos"), "url", F.concat(F.lit("Page "), F.col("page_id").cast("string")).alias("title"), F.lit(0.5).alias("score"))


@query("""
WITH r AS (SELECT page_id % 10 AS q, row_number() OVER (PARTITION BY page_id % 10 ORDER BY page_id) - 1 AS pos, regexp_replace(url, '[?#].*$', '') AS url,
  'Page ' || page_id AS title, count(*) OVER (PARTITION BY page_id % 10) AS n FROM pages),
g AS (SELECT url, sum(n - pos + 0.5) AS gain, count(*) AS hits, min(q * 1000000 + pos) AS seen, arg_min(title, q * 1000000 + pos) AS title
  FROM r WHERE NOT regexp_matches(lower(url), '\\.(pdf|jpg|jpeg|png|webp|gif|zip|rar|doc|docx|xls|xlsx|mp4|exe)$') GROUP BY url),
s AS (SELECT *, regexp_extract(url, '^(?:[^/]*//)?[^/]*(/.*)$', 1) AS path FROM g),
m AS (SELECT *, lower(regexp_extract(path, '(?i)/([a-z]{2})[-_]([a-z]{2})(/|$)', 1)) AS a, lower(regexp_extract(path, '(?i)/([a-z]{2})[-_]([a-z]{2})(/|$)', 2)) AS b FROM s),
t AS (SELECT url, title, seen, gain + 1.5 * (hits - 1) + CASE WHEN a <> '' AND (a IN ('en','uk','ua') OR b IN ('en','uk','ua')) THEN 4 WHEN a <> '' THEN -4
  WHEN regexp_matches(url, '(?i)/(ua|uk|en)(/|$)|[?&]lang=(en|uk|ua)') THEN 4 ELSE 0 END
  - CASE WHEN regexp_matches(url, '(?i)supportdetail|productservice|product-service|/servis|/services?/|/get-help|/customer|/warranty|/repair|/manual|/download|/instruction|/spares|/faq|/register|/where-to-buy|/store-locator') THEN 12 ELSE 0 END AS total FROM m)
SELECT url, title, round(total, 4)::DOUBLE AS total, (row_number() OVER (ORDER BY total DESC, seen))::INT AS rank FROM t""")
def rank_sources(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rank_sources(_results(spark, d)).select("url", "title", F.round("total", 4).alias("total"), "rank")


@query("""
SELECT host, page_id, rank FROM (SELECT regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\\.', '') AS host, page_id,
  (row_number() OVER (PARTITION BY regexp_replace(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '^www\\.', '') ORDER BY strlen(html) DESC, page_id))::INT AS rank FROM pages)
WHERE rank <= 5""")
def top_per_host(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select(urls.bare_host(F.col("url")).alias("host"), "page_id", F.octet_length("html").alias("total"))
    return ranking.top_sources(ranking.ranked(p, ["host"], "page_id")).select("host", "page_id", "rank")


@query("""
WITH t AS (SELECT p_partkey, list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+(?:-[a-z0-9]+)*'), lambda x: length(x) > 1) AS n,
  list_distinct(regexp_extract_all(lower(p_type || ' ' || p_name), '[a-z0-9]+(?:-[a-z0-9]+)*')) AS t FROM part)
SELECT p_partkey AS product_id, round(CASE WHEN len(n) = 0 THEN 0 ELSE len(list_filter(n, lambda x: list_contains(t, x))) / len(n) END, 6)::DOUBLE AS coverage FROM t""")
def relevance_coverage(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_name").alias("search"), F.concat_ws(" ", "p_type", "p_name").alias("title"))
    return ranking.relevance_parts(p).select("product_id", F.round("coverage", 6).alias("coverage"))


@query()
def relevance(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), *[F.lit(None).cast("string").alias(c) for c in ("category", "article", "mpn", "ean13", "upc")], F.col("p_brand").alias("brand"))
    pages = table(spark, d, "pages").select((F.col("page_id") % 20 + 1).alias("product_id"), F.col("page_id").alias("page_rank"), "html", F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))
    return ranking.keep_relevant(ranking.relevance(p, pages), floor=None).select("product_id", "page_rank", "relevance", "rank")


@query("""
WITH s AS (SELECT a.vec_id AS attr, b.vec_id AS label, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY attr ORDER BY score DESC, label DESC) AS k, lead(score) OVER (PARTITION BY attr ORDER BY score DESC, label DESC) AS next FROM s)
SELECT attr, label FROM r WHERE k = 1 AND score >= 0.35 AND score - coalesce(next, -1) >= 0.02""")
def ann_match(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    a = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("attr"), F.col("embedding").alias("av"))
    b = e.select(F.col("vec_id").alias("label"), F.col("embedding").alias("lv"))
    scores = matching.ann_scores(a, b, itself=False, places=6)
    return matching.ann_match(scores, cfg=EngineConfig(ann_accept=0.35, ann_margin=0.02))


@query("""
WITH t AS (SELECT p_partkey, list_distinct(list_filter(string_split(trim(regexp_replace(lower(p_type), '[^a-z0-9_]+', ' ', 'g')), ' '), lambda x: x <> '')) AS t FROM part),
a AS (SELECT * FROM (VALUES ('polished brass', ['polished','brass']), ('economy steel', ['economy','steel']), ('tin', ['tin'])) v(attr, w))
SELECT p_partkey AS product_id, attr, round(len(list_intersect(t, w)) / len(list_distinct(list_concat(t, w))), 6)::DOUBLE AS jaccard
FROM t, a WHERE len(list_intersect(t, w)) > 0""")
def token_overlap(spark: SparkSession, d: str) -> DataFrame:
    a = spark.createDataFrame([("polished brass",), ("economy steel",), ("tin",)], "attr string").withColumn("w", core_tokens(F.lower("attr")))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), core_tokens(text.label_key(F.col("p_type"))).alias("t"))
    words = a.select("attr", "w", F.explode("w").alias("word"))
    hits = p.select("product_id", "t", F.explode("t").alias("word")).join(F.broadcast(words), "word").select("product_id", "attr", "t", "w").distinct()
    return hits.select("product_id", "attr", F.round(F.size(F.array_intersect("t", "w")) / F.size(F.array_union("t", "w")), 6).alias("jaccard"))


@query("""
WITH v AS (SELECT p_partkey, ['96 GB', '2,1 kW', '350 ml', '60 cm', '1000 MHz', 'none'][(p_partkey % 6)::INT + 1] AS raw, ['MB', 'W', 'l', 'mm', 'GHz', 'kg'][(p_partkey % 6)::INT + 1] AS unit FROM part)
SELECT p_partkey AS product_id, CASE p_partkey % 6 WHEN 0 THEN '96000' WHEN 1 THEN '2100' WHEN 2 THEN '0.35' WHEN 3 THEN '600' WHEN 4 THEN '1' END AS value,
  CASE WHEN p_partkey % 6 < 5 THEN unit END AS unit, CASE WHEN p_partkey % 6 < 5 THEN 0.92 END::DOUBLE AS confidence FROM v""")
def unit_convert(spark: SparkSession, d: str) -> DataFrame:
    k = (F.col("p_partkey") % 6 + 1).cast("int")
    raw, unit = F.element_at(F.array(*map(F.lit, ("96 GB", "2,1 kW", "350 ml", "60 cm", "1000 MHz", "none"))), k), F.element_at(F.array(*map(F.lit, ("MB", "W", "l", "mm", "GHz", "kg"))), k)
    p = table(spark, d, "part").select("p_partkey", raw.alias("raw"), unit.alias("unit")).withColumn("pairs", quantity.number_units("raw"))
    return p.select(F.col("p_partkey").alias("product_id"), quantity.to_number(F.col("pairs"), F.col("unit")).alias("n")).select("product_id", "n.*")


@query("""
SELECT p_partkey AS product_id, CASE p_partkey % 3 WHEN 0 THEN 'kg' WHEN 1 THEN 'kw' END AS unit FROM part""")
def label_unit(spark: SparkSession, d: str) -> DataFrame:
    label = F.element_at(F.array(F.lit("Weight, кг"), F.lit("Power (kW)"), F.lit("Color, main")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), quantity.label_unit(label).alias("unit"))


@query("""
SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '^(yes|true|present|supported|available)( |$)') THEN 'true'
  WHEN regexp_matches(lower(text), '\\b(no|not|none|without)\\b') OR regexp_matches(lower(text), '^(false|absent|unsupported)( |$)') THEN 'false'
  WHEN length(text) <= 80 THEN 'true' END AS value
FROM (SELECT conv_id, turn, trim(regexp_replace(text, '[^A-Za-z ]', '', 'g')) AS text FROM conversations) WHERE regexp_matches(text, '^[A-Za-z]')""")
def to_boolean(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select("conv_id", "turn", F.trim(F.regexp_replace("text", "[^A-Za-z ]", "")).alias("text")).where(F.col("text").rlike("^[A-Za-z]"))
    return c.select("conv_id", "turn", values.to_boolean(F.col("text")).alias("value"))


@query("""
SELECT p_partkey AS product_id, CASE WHEN regexp_matches(lower(p_type), '(^|[^a-z0-9])stainless steel([^a-z0-9]|$)') THEN 'Stainless Steel'
  WHEN regexp_matches(lower(p_type), '(^|[^a-z0-9])copper([^a-z0-9]|$)') THEN 'COPPER' WHEN regexp_matches(lower(p_type), '(^|[^a-z0-9])steel([^a-z0-9]|$)') THEN 'Steel'
  WHEN regexp_matches(lower(p_type), '(^|[^a-z0-9])brass([^a-z0-9]|$)') THEN 'brass' WHEN regexp_matches(lower(p_type), '(^|[^a-z0-9])tin([^a-z0-9]|$)') THEN 'Tin' END AS value FROM part""")
def enum_snap(spark: SparkSession, d: str) -> DataFrame:
    allowed = F.array(*map(F.lit, ("Tin", "Steel", "brass", "COPPER", "Stainless Steel")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), values.snap(F.col("p_type"), allowed).alias("value"))


@query("SELECT lang, source, min(doc_id) AS doc_id FROM documents GROUP BY lang, source")
def keep_first(spark: SparkSession, d: str) -> DataFrame:
    return matching.keep_first(table(spark, d, "documents").select("lang", "source", "doc_id"), ["lang", "source"], "doc_id")


_SPEC_SQL = """
WITH s AS (SELECT p_partkey AS page_id, p_partkey % 40 AS product_id, p_type AS grp, 'n' || (p_size % 3) AS name, p_brand AS value,
  (row_number() OVER (PARTITION BY p_partkey % 40 ORDER BY p_size DESC, p_partkey))::INT AS page_rank FROM part)"""


def _part_specs(spark: SparkSession, d: str) -> DataFrame:
    """Parts as pages of 40 products: a group, a name and a value each; larger sizes come first."""
    rank = F.row_number().over(Window.partitionBy(F.col("p_partkey") % 40).orderBy(F.col("p_size").desc(), "p_partkey"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), (F.col("p_partkey") % 40).alias("product_id"), F.col("p_type").alias("grp"), F.concat(F.lit("n"), (F.col("p_size") % 3).cast("string")).alias("name"), F.col("p_brand").alias("value"), rank.alias("page_rank"), F.lit(0).alias("seq"))


@query(_SPEC_SQL + """, f AS (SELECT *, row_number() OVER (PARTITION BY product_id, grp, name ORDER BY page_rank) AS r FROM s WHERE page_rank <= 3)
SELECT product_id, grp, (row_number() OVER (PARTITION BY product_id, grp ORDER BY page_rank))::INT AS seq, name, value FROM f WHERE r = 1""")
def merge_groups(spark: SparkSession, d: str) -> DataFrame:
    return specs.merge_groups(_part_specs(spark, d))


@query(_SPEC_SQL + " SELECT product_id, count(*)::BIGINT AS n, count(DISTINCT grp)::BIGINT AS groups, (2 * count(*) + 3 * count(DISTINCT grp))::BIGINT AS score FROM s GROUP BY product_id")
def specs_score(spark: SparkSession, d: str) -> DataFrame:
    return specs.specs_score(_part_specs(spark, d), ["product_id"])


def _line_candidates(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as candidates: each part's return flag, told by its lines with a confidence from the discount."""
    method = F.element_at(F.array(*map(F.lit, ("infobox", "css_selector", "jsonld", "llm"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    order = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber")
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("product_id"), F.lit(0).alias("attr_idx"), F.row_number().over(order).alias("cand_idx"), F.col("l_returnflag").alias("value"), F.lit(None).cast("string").alias("unit"), (0.5 + F.round(F.col("l_discount") * 4, 2)).alias("confidence"), method.alias("method"), F.concat(F.lit("https://s"), F.col("l_suppkey").cast("string"), F.lit(".example/")).alias("url"), F.lit("").alias("title"), F.col("l_returnflag").alias("raw_value"))


@query("""
WITH c AS (SELECT l_partkey AS p, lower(l_returnflag) AS k, l_returnflag AS v, 0.5 + round(l_discount * 4, 2) AS conf, l_linenumber % 4 AS m, l_suppkey AS s,
  row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS i FROM lineitem),
g AS (SELECT p, k, arg_max(v, conf * 1000000 - i) AS v, max(conf) AS conf, arg_max(m, conf * 1000000 - i) AS m,
  sum(conf * CASE m WHEN 2 THEN 0.9 WHEN 3 THEN 0.7 ELSE 1.0 END) AS score, count(DISTINCT s) AS sites, count(*) AS n, min(i) AS first FROM c GROUP BY p, k),
r AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS next, sum(score) OVER (PARTITION BY p) AS total, sum(n) OVER (PARTITION BY p) AS n_sources
  FROM g WINDOW w AS (PARTITION BY p ORDER BY round(score, 9) DESC, first)),
b AS (SELECT *, least(score / total * CASE WHEN next >= 0.7 * score THEN 0.75 ELSE 1 END, conf) AS base FROM r WHERE r = 1)
SELECT p AS product_id, v AS value, round(CASE WHEN sites >= 2 THEN least(0.97, base * 1.15) ELSE base * CASE m WHEN 2 THEN 0.95 WHEN 3 THEN 0.85 ELSE 1 END END, 4)::DOUBLE AS confidence, n_sources::BIGINT AS n_sources FROM b""")
def weighted_vote(spark: SparkSession, d: str) -> DataFrame:
    c = _line_candidates(spark, d)
    return reconcile.vote(reconcile.equal(reconcile.by_value(c))).select("product_id", "value", "confidence", "n_sources")


@query("SELECT l_partkey AS product_id, l_returnflag AS value, count(DISTINCT l_suppkey)::BIGINT AS sites FROM lineitem GROUP BY 1, 2")
def corroboration(spark: SparkSession, d: str) -> DataFrame:
    return _line_candidates(spark, d).groupBy("product_id", "value").agg(F.count_distinct(reconcile.site(F.col("url"))).alias("sites"))


@query("""
SELECT product_id, tier, value FROM (SELECT *, min(tier) OVER (PARTITION BY product_id) AS t FROM (
  SELECT l_partkey AS product_id, l_linenumber AS tier, l_returnflag AS value FROM lineitem)) WHERE tier = t""")
def tier_ladder(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").select(F.col("l_partkey").alias("product_id"), F.lit(0).alias("attr_idx"), F.col("l_linenumber").alias("tier"), F.col("l_returnflag").alias("value"))
    return reconcile.lowest_tier(c).select("product_id", "tier", "value")


@query("""
SELECT p_partkey, p_type FROM part WHERE p_partkey % 3 <> 0
UNION ALL SELECT p_partkey, p_type FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_partkey % 3 <> 0 AND b.p_type = a.p_type)""")
def anti_merge(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_type")
    return resolve.anti_merge(p.where("p_partkey % 3 <> 0"), p, ["p_type"])


@query("""
WITH n AS (SELECT page_id % 50 AS product_id, page_id AS page_rank, (length(html) - length(replace(html, '<li', ''))) // 3 % 3 AS n FROM pages),
w AS (SELECT *, sum((n > 0)::INT) OVER (PARTITION BY product_id ORDER BY page_rank) AS k, max(n) OVER (PARTITION BY product_id) AS m, row_number() OVER (PARTITION BY product_id ORDER BY page_rank) AS i FROM n)
SELECT product_id, page_rank, n::BIGINT AS n FROM w WHERE (m > 0 AND n > 0 AND k <= 3) OR (m = 0 AND i <= 3)""")
def productive_pages(spark: SparkSession, d: str) -> DataFrame:
    n = F.expr("(length(html) - length(replace(html, '<li', ''))) div 3 % 3")
    return resolve.productive_pages(table(spark, d, "pages").select((F.col("page_id") % 50).alias("product_id"), F.col("page_id").alias("page_rank"), n.alias("n")))


@query("""
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS grp FROM conversations""")
def carry_heading(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("h", F.when(F.col("role") == "user", F.col("text")))
    return specs.carry_heading(c, ["conv_id"], "turn", "h").select("conv_id", "turn", "grp")


def _events(spark: SparkSession, d: str, key: str) -> DataFrame:
    return table(spark, d, "events").withColumns({"ts": F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, key: F.col("user_id").cast("string")})


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, event_id, ts, i, ts AS start, 1 AS n FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.ts, e.i, CASE WHEN e.ts - f.start >= 86400 THEN e.ts ELSE f.start END, CASE WHEN e.ts - f.start >= 86400 THEN 1 ELSE f.n + 1 END
  FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id::VARCHAR AS client, event_id, n <= 2 AS allowed, CASE WHEN n <= 2 THEN 0 ELSE trunc(86400 - (ts - start)) END::INT AS retry_after FROM f""")
def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return stateful.rate_limit(_events(spark, d, "client"), 2, 86400.0).drop("ts")


@query("""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
SELECT event_id, round(max(ts - i * 3600.0) OVER (PARTITION BY user_id ORDER BY i) + i * 3600.0, 3)::DOUBLE AS at FROM e""")
def pacing(spark: SparkSession, d: str) -> DataFrame:
    return stateful.pacing(_events(spark, d, "client"), ["client"], 3600.0).select("event_id", F.round("at", 3).alias("at"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS ts, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, event_id, i, false AS rejected, CASE WHEN t = 'error' THEN 1 ELSE 0 END AS run, 0.0::DOUBLE AS until FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.i, e.ts < f.until,
    CASE WHEN e.ts < f.until THEN f.run WHEN t = 'purchase' THEN 0 WHEN t = 'error' THEN f.run + 1 ELSE f.run END,
    CASE WHEN e.ts >= f.until AND t = 'error' AND f.run + 1 >= 2 THEN e.ts + 86400 ELSE f.until END
  FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id::VARCHAR AS service, event_id, rejected FROM f""")
def breaker(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "purchase", "ok").when(F.col("event_type") == "error", "refused").otherwise("other")
    return stateful.breaker(_events(spark, d, "service").withColumn("kind", kind), open_s=86400.0).select("service", "event_id", "rejected")


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, event_id, i, false AS hit, ts AS written FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.i, e.ts < f.written + 86400, CASE WHEN e.ts < f.written + 86400 THEN f.written ELSE e.ts END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id::VARCHAR AS key, event_id, hit FROM f""")
def ttl_cache(spark: SparkSession, d: str) -> DataFrame:
    return stateful.ttl_cache(_events(spark, d, "key"), 86400.0).drop("ts")


@query("""
SELECT doc_id, instr(text, split_part(source, 'c', 1)) - 1 AS char_start FROM documents""")
def claim_offsets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", (F.instr(F.col("text"), F.substring_index("source", "c", 1)) - 1).cast("long").alias("char_start"))


@query("""
SELECT p_partkey AS product_id, q.i::BIGINT AS query_idx, CASE q.i WHEN 0 THEN '"' || p_brand || ' ' || p_name || '" Size specifications' ELSE p_brand || ' ' || p_name || ' specifications Size' END AS query
FROM part, (VALUES (0), (1)) q(i)""")
def query_templates(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), *[F.lit(None).cast("string").alias(c) for c in ("category", "article", "mpn", "ean13", "upc")])
    return ranking.query_templates(p, "Size").withColumn("query_idx", F.col("query_idx").cast("long"))


@query("SELECT round(100 * avg((quality = 1)::INT), 6)::DOUBLE AS correct, count(*)::BIGINT AS n FROM labels")
def accuracy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").agg(F.round(100 * F.avg((F.col("quality") == 1).cast("double")), 6).alias("correct"), F.count("*").alias("n"))


@query()
def fuzzy_labels(spark: SparkSession, d: str) -> DataFrame:
    return matching.fuzzy_labels(part_attrs(spark, d), matching.pool_labels(part_pool(spark, d)))


@query()
def label_similarity_types(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").select("p_type").distinct()
    return t.select("p_type", label_similarity(F.col("p_type"), F.lit("polished steel")).alias("sim"))


@query()
def fuzzy_clusters(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    order = Window.partitionBy("p_brand").orderBy("p_partkey")
    c = p.select(F.regexp_extract("p_brand", r"\d+", 0).cast("long").alias("product_id"), F.lit(0).alias("attr_idx"), F.col("p_type").alias("value"), F.row_number().over(order).alias("cand_idx"))
    return reconcile.clusters(c)


@query()
def html_specs(spark: SparkSession, d: str) -> DataFrame:
    return html.extract_specs(table(spark, d, "pages"))


@query()
def spec_links(spark: SparkSession, d: str) -> DataFrame:
    return html.spec_links(table(spark, d, "pages"))


@query()
def text_repair(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.repair("text").alias("text"), text.mojibake_count(F.col("text")).alias("marks"))


@query()
def claims(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "part").select(F.col("p_partkey").alias("text_id"), F.format_string("Brand: %s\nSize, mm: %d | Type: %s", "p_brand", "p_size", "p_type").alias("text"))
    return resolve.claims_from_text(made)


@query("""
SELECT p_partkey AS product_id, a.i AS attr_idx, a.n AS name,
  CASE a.i WHEN 0 THEN CASE WHEN p_size % 10 = 0 THEN (p_size // 10)::VARCHAR ELSE (p_size // 10)::VARCHAR || '.' || (p_size % 10)::VARCHAR END WHEN 1 THEN p_type WHEN 2 THEN p_brand END AS value,
  CASE a.i WHEN 0 THEN 'cm' END AS unit, CASE a.i WHEN 0 THEN round(0.88 * 0.92, 4) WHEN 1 THEN round(0.80 * 0.85, 4) WHEN 2 THEN round(0.88 * 0.85, 4) ELSE 0 END::DOUBLE AS confidence,
  CASE WHEN a.i < 3 THEN 'found' ELSE 'not_found' END AS status
FROM part, (VALUES (0, 'Size'), (1, 'Type'), (2, 'Brand'), (3, 'Weight')) a(i, n)""")
def resolve_parts(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: typed attributes of all parts, from their labelled values to converted answers with confidence."""
    out = resolve.resolve_from_pool(part_attrs(spark, d), part_pool(spark, d))
    return out.select("product_id", "attr_idx", "name", "value", "unit", "confidence", "status")
