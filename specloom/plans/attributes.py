"""Queries of the single-attribute path, of models' replies and of pages with specifications, over pages made from `part`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.functions import text, urls
from specloom.operators import attribute, benchmark, matching, ranking, resolve
from specloom.plans.queries import query, table
from specloom.sources import html, replies, targeted
from specloom.sources.tables import TableProvider
from specloom.streaming import stateful

ATTRS = ("Size", "Brand", "Weight")


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").withColumnRenamed("p_partkey", "product_id").withColumn("k", F.col("product_id"))


def _attrs(spark: SparkSession, d: str, names: tuple[str, ...] = ATTRS) -> DataFrame:
    a = F.array(*[F.struct(F.lit(i).alias("attr_idx"), F.lit(n).alias("name")) for i, n in enumerate(names)])
    return _parts(spark, d).select("product_id", F.explode(a).alias("a")).select("product_id", "a.*")


def _by(k: int, *values: Column) -> Column:
    """The value at the place of the part's key modulo k."""
    return F.element_at(F.array(*values), (F.col("k") % k + 1).cast("int"))


def _page(spark: SparkSession, d: str, address: Column, markup: Column) -> DataFrame:
    return _parts(spark, d).select("product_id", F.col("k").alias("page_id"), F.lit(1).alias("page_rank"), address.alias("url"), F.col("p_name").alias("title"), markup.alias("html"))


def _shop_pages(spark: SparkSession, d: str) -> DataFrame:
    """A page a part: of a site with a row pattern, of one with a flat pattern, or with a plain table; the first two hold a wrong table as well."""
    id_, wrong = F.format_string("<p>ART-%d-X</p>", "k"), F.lit("<table><tr><td>Size</td><td>999</td></tr></table>")
    rows = F.format_string('<table class="specs-list"><tr><td class="ttl">Size</td><td class="nfo">%d</td></tr><tr><td class="ttl">Brand</td><td class="nfo">%s</td></tr></table>', "p_size", "p_brand")
    flat = F.format_string('<section class="techpowerup-specs"><dl><dt>Size</dt><dd>%d</dd><dt>Brand</dt><dd>%s</dd></dl></section>', "p_size", "p_brand")
    plain = F.format_string("<table><tr><th>Size</th><td>%d</td></tr><tr><th>Brand</th><td>%s</td></tr></table>", "p_size", "p_brand")
    site = _by(3, F.lit("www.gsmarena.com"), F.lit("www.techpowerup.com"), F.lit("shop.example"))
    return _page(spark, d, F.concat(F.lit("https://"), site, F.lit("/"), F.col("k").cast("string")), F.concat(id_, _by(3, F.concat(rows, wrong), F.concat(flat, wrong), plain)))


@query("""
SELECT p_partkey AS product_id, a.i AS attr_idx, CASE a.i WHEN 0 THEN p_size::VARCHAR ELSE p_brand END AS value, 1.0::DOUBLE AS confidence, 'css_selector' AS method
FROM part, (VALUES (0), (1)) a(i)""")
def site_rows(spark: SparkSession, d: str) -> DataFrame:
    return attribute.row_candidates(_attrs(spark, d), _shop_pages(spark, d)).select("product_id", "attr_idx", "value", "confidence", "method")


@query("""
SELECT p_partkey AS page_id, 2 AS kind, 2::BIGINT AS n FROM part WHERE p_partkey % 3 = 2
UNION ALL SELECT p_partkey, 2, CASE p_partkey % 3 WHEN 0 THEN 3 ELSE 3 END FROM part WHERE p_partkey % 3 < 2
UNION ALL SELECT p_partkey, p_partkey % 3, 2 FROM part WHERE p_partkey % 3 < 2""")
def page_row_kinds(spark: SparkSession, d: str) -> DataFrame:
    return targeted.page_rows(_shop_pages(spark, d)).groupBy("page_id", "kind").agg(F.count("*").alias("n"))


_TOLD = "repeat('The refresh of ' || p_name || ' is fine. ', 9)"


@query(f"""
SELECT p_partkey AS product_id, CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR ELSE left({_TOLD}, 300) END AS value,
  CASE WHEN p_partkey % 2 = 0 THEN 0.9 ELSE 0.75 END::DOUBLE AS confidence, 'jsonld' AS method FROM part""")
def linked_data(spark: SparkSession, d: str) -> DataFrame:
    """Half of the products state a property, all have a description that mentions the attribute; one is wrapped in a graph."""
    told = F.repeat(F.format_string("The refresh of %s is fine. ", "p_name"), 9)
    node = F.concat(F.lit('{"@type":["Product"],'), F.when(F.col("k") % 2 == 0, F.format_string('"additionalProperty":[{"name":"Refresh rate","value":%d},{"name":"Other","value":"x"}],', "p_size")).otherwise(""), F.lit('"description":"'), told, F.lit('"}'))
    doc = F.when(F.col("k") % 3 == 0, F.concat(F.lit('{"@graph":['), node, F.lit("]}"))).otherwise(node)
    pages = _page(spark, d, F.lit("https://shop.example/"), F.concat(F.lit('<script type="application/ld+json">'), doc, F.lit("</script>")))
    return attribute.linked_candidates(_attrs(spark, d, ("Refresh rate",)), pages).select("product_id", "value", "confidence", "method")


def _boxes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = _parts(spark, d)
    head = ("product_id", F.lit("https://box.example/").alias("url"), F.lit("").alias("title"))
    boxes = p.select(*head, F.lit(0).alias("box_idx"), F.array(F.struct(F.lit("Size").alias("label"), F.col("p_size").cast("string").alias("value"))).alias("attributes"), F.concat(F.lit("The brand of it is "), "p_brand").alias("content"))
    return boxes, p.select(*head, F.lit(0).alias("pos"), F.format_string("The weight is %d kg", "p_size").alias("answer"))


@query("""
SELECT p_partkey AS product_id, a.i AS attr_idx, CASE a.i WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN 'The brand of it is ' || p_brand ELSE 'The weight is ' || p_size || ' kg' END AS value,
  CASE a.i WHEN 0 THEN 0.95 WHEN 1 THEN 0.5 ELSE 0.7 END::DOUBLE AS confidence FROM part, (VALUES (0), (1), (2)) a(i)""")
def search_boxes(spark: SparkSession, d: str) -> DataFrame:
    return attribute.box_candidates(_attrs(spark, d), *_boxes(spark, d)).select("product_id", "attr_idx", "value", "confidence")


@query("""
SELECT p_partkey AS product_id, 0 AS attr_idx, 'css_selector' AS method, 1::BIGINT AS n, 1.0::DOUBLE AS top FROM part
UNION ALL SELECT p_partkey, 1, 'css_selector', 1, 1.0 FROM part
UNION ALL SELECT p_partkey, 2, 'llm', 3, least(0.85, p_size / 50.0)::DOUBLE FROM part""")
def model_gate(spark: SparkSession, d: str) -> DataFrame:
    """Replies for four pages of every attribute; only those of the first three pages count, and only for what no extractor is sure of."""
    reply = F.format_string('```json\n{"found": true, "value": "%d", "confidence": %s}\n```', "p_size", (F.col("p_size") / 50).cast("string"))
    given = _attrs(spark, d).join(_parts(spark, d).select("product_id", reply.alias("reply")), "product_id").withColumn("page_rank", F.explode(F.sequence(F.lit(1), F.lit(4))))
    given = given.withColumns({"url": F.concat(F.lit("https://p"), F.col("page_rank").cast("string")), "title": F.lit("")})
    found = attribute.pipeline_candidates(_attrs(spark, d), _shop_pages(spark, d), replies=given)
    return found.groupBy("product_id", "attr_idx", "method").agg(F.count("*").alias("n"), F.max("confidence").alias("top"))


@query("""
SELECT p_partkey AS product_id, a.i AS attr_idx, CASE a.i WHEN 0 THEN p_size || ' mm' ELSE p_size || ' mm' END AS value, CASE a.i WHEN 0 THEN 0.88 ELSE 0.72 END::DOUBLE AS confidence, (CASE a.i WHEN 0 THEN 0 ELSE 2 END)::INT AS tier
FROM part, (VALUES (0), (1)) a(i)""")
def pool_ladder(spark: SparkSession, d: str) -> DataFrame:
    """A label alike answers Size; Height is read from dimensions with the order of their axes."""
    rows = F.array(F.struct(F.lit(0).alias("seq"), F.lit("Size, mm").alias("name"), F.col("p_size").cast("string").alias("value")), F.struct(F.lit(1).alias("seq"), F.lit("Dimensions (WxHxD), mm").alias("name"), F.format_string("10 x %d x 30", "p_size").alias("value")))
    pool = _parts(spark, d).select("product_id", F.explode(rows).alias("x")).select("product_id", F.col("x.seq").cast("long").alias("seq"), "x.name", "x.value", F.lit("u").alias("url"), F.lit("").alias("title"))
    return attribute.pool_ladder(_attrs(spark, d, ("Size", "Height")), pool).select("product_id", "attr_idx", "value", "confidence", "tier")


@query("""
SELECT p_partkey AS product_id, a.i AS attr_idx, CASE a.i WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_brand END AS value, CASE WHEN a.i < 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence,
  CASE WHEN a.i < 2 THEN 'found' ELSE 'not_found' END AS status FROM part, (VALUES (0), (1), (2)) a(i)""")
def get_attribute(spark: SparkSession, d: str) -> DataFrame:
    """The whole single-attribute path; every fifth page is empty until it is rendered."""
    pages, empty = _shop_pages(spark, d), F.col("page_id") % 5 == 0
    static = pages.withColumn("html", F.when(empty, F.format_string("<p>ART-%d-X</p>", "page_id")).otherwise(F.col("html")))
    p = _parts(spark, d).select("product_id", F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.format_string("ART-%d-X", "k").alias("article"), *[F.lit(None).cast("string").alias(c) for c in ("category", "mpn", "ean13", "upc")])
    out = attribute.get_attribute(p, _attrs(spark, d), static, rendered=pages.where(empty).select("page_id", "html"))
    return out.select("product_id", "attr_idx", "value", "confidence", "status")


@query("""
SELECT p_partkey AS product_id, a.i AS attr_idx, CASE a.i WHEN 0 THEN p_size || ' mm' WHEN 1 THEN p_brand ELSE 'The weight is ' || p_size || ' kg' END AS value,
  CASE a.i WHEN 0 THEN 0.88 WHEN 1 THEN 1.0 ELSE 0.7 END::DOUBLE AS confidence FROM part, (VALUES (0), (1), (2)) a(i)""")
def fill_ladder(spark: SparkSession, d: str) -> DataFrame:
    """Size stands in the pool, Brand only in the pages' tables, Weight only in an answer of the search."""
    pool = _parts(spark, d).select("product_id", F.lit(0).cast("long").alias("seq"), F.lit("Size, mm").alias("name"), F.col("p_size").cast("string").alias("value"), F.lit("u").alias("url"), F.lit("").alias("title"))
    boxes, answers = _boxes(spark, d)
    return attribute.fill_ladder(_parts(spark, d), _attrs(spark, d), pool, _shop_pages(spark, d), boxes.limit(0), answers).select("product_id", "attr_idx", "value", "confidence")


@query("""
SELECT product_id FROM (SELECT p_partkey % 30 AS product_id, count(*) AS n, count(DISTINCT CASE WHEN p_size > 10 THEN p_size END) AS p FROM part GROUP BY 1) WHERE n >= 40 AND p >= 2""")
def rich_pools(spark: SparkSession, d: str) -> DataFrame:
    p = _parts(spark, d).withColumn("product_id", F.col("k") % 30)
    return attribute.rich_pools(p, p.groupBy("product_id", F.col("p_size").alias("page_rank")).agg(F.sum((F.col("p_size") > 10).cast("int")).alias("n")))


@query("""
WITH q AS (SELECT p_partkey AS product_id, i AS query_idx, CASE WHEN p_partkey % 4 > i THEN 'site:a.example ' || p_name ELSE p_name || ' ' || i END AS query FROM part, (VALUES (0), (1), (2)) v(i)),
n AS (SELECT *, query LIKE '%site:%' AS s, max((query NOT LIKE '%site:%')::INT) OVER (PARTITION BY product_id) AS o FROM q)
SELECT product_id, query_idx, query FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY query_idx) AS r FROM n WHERE o = 0 OR NOT s) WHERE r <= 2""")
def open_queries(spark: SparkSession, d: str) -> DataFrame:
    q = _parts(spark, d).select("product_id", "k", "p_name", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("query_idx"))
    made = F.when(F.col("k") % 4 > F.col("query_idx"), F.concat(F.lit("site:a.example "), "p_name")).otherwise(F.concat_ws(" ", "p_name", F.col("query_idx").cast("string")))
    return attribute.open_queries(q.select("product_id", "query_idx", made.alias("query")))


@query("""
SELECT p_partkey AS product_id, CASE WHEN p_partkey % 2 <> 0 THEN 0 ELSE 1 END AS attempt, (CASE WHEN p_partkey % 2 <> 0 OR p_partkey % 3 <> 0 THEN 1 ELSE 0 END)::INT AS hits FROM part""")
def search_retry(spark: SparkSession, d: str) -> DataFrame:
    """The first attempt of every other search is empty, the second of every third; a third attempt is never taken."""
    n = F.element_at(F.array(F.col("k") % 2, F.col("k") % 3, F.lit(1).cast("long")), F.col("attempt") + 1)
    a = _parts(spark, d).select("product_id", "k", F.lit(0).alias("query_idx"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("attempt"))
    a = a.withColumn("hits", F.when(n != 0, F.array(F.lit("hit"))).otherwise(F.array().cast("array<string>"))).drop("k")
    return attribute.first_answered(a).select("product_id", "attempt", F.size("hits").alias("hits"))


@query("""
SELECT p_partkey AS fetch_id, CASE WHEN p_partkey % 9 = 0 THEN 'https://a.example/0' ELSE 'https://b.example/' || (p_partkey % 9) END AS url, (p_partkey % 9)::INT AS hops FROM part
WHERE p_partkey % 9 <= 5 AND NOT (p_partkey % 4 = 0 AND p_partkey % 9 >= 1)""")
def safe_redirects(spark: SparkSession, d: str) -> DataFrame:
    """Fetches of up to eight redirects; every fourth is sent to an address of a private network first."""
    h = _parts(spark, d).select(F.col("k").alias("fetch_id"), F.explode(F.sequence(F.lit(0), (F.col("k") % 9).cast("int"))).alias("hop"))
    to = F.when(F.col("hop") == 0, "https://a.example/0").when((F.col("fetch_id") % 4 == 0) & (F.col("hop") == 1), "http://10.0.0.7/").otherwise(F.concat(F.lit("https://b.example/"), F.col("hop").cast("string")))
    return attribute.safe_redirects(h.withColumn("url", to))


@query("""
SELECT p_partkey AS product_id, 'Product name: "' || p_name || '"' || chr(10) || 'Brand: "' || p_brand || '"' || CASE WHEN p_partkey % 2 = 0 THEN chr(10) || 'Category: "' || p_type || '"' ELSE '' END || chr(10) || 'EAN-13: ' || p_partkey AS context FROM part""")
def product_context(spark: SparkSession, d: str) -> DataFrame:
    p = _parts(spark, d).select("product_id", F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.when(F.col("k") % 2 == 0, F.col("p_type")).otherwise("").alias("category"), F.lit(None).cast("string").alias("article"), F.col("k").cast("string").alias("ean13"), F.lit("").alias("upc"))
    return attribute.product_context(p)


@query("""
SELECT p_partkey AS product_id, p_brand AS value, least(0.85, p_size / 40.0)::DOUBLE AS confidence FROM part WHERE p_partkey % 5 IN (0, 1)
UNION ALL SELECT p_partkey, p_brand, 0.7 FROM part WHERE p_partkey % 5 = 2""")
def model_values(spark: SparkSession, d: str) -> DataFrame:
    """Replies with a confidence, in a fence, without one, with nothing found, and with no object at all."""
    sure = F.format_string('{"found": true, "value": "%s", "confidence": %s}', "p_brand", (F.col("p_size") / 40).cast("string"))
    reply = _by(5, sure, F.concat(F.lit("```json\n"), sure, F.lit("\n```")), F.format_string('{"found": true, "value": "%s"}', "p_brand"), F.lit('{"found": false, "value": "x"}'), F.lit("no json"))
    r = _parts(spark, d).select("product_id", F.lit(0).alias("attr_idx"), F.lit(1).alias("page_rank"), F.lit("u").alias("url"), F.lit("").alias("title"), reply.alias("reply"))
    return replies.extracted(r).select("product_id", "value", "confidence")


@query("""
SELECT p_partkey AS product_id, a.i AS attr_idx, CASE WHEN p_partkey % 2 = 0 THEN CASE a.i WHEN 0 THEN p_brand ELSE NULL END ELSE CASE a.i WHEN 0 THEN 'raw' END END AS value,
  CASE WHEN p_partkey % 2 = 0 THEN CASE a.i WHEN 0 THEN 1.0 ELSE 0.6 END ELSE CASE a.i WHEN 0 THEN 0.5 ELSE 0 END END::DOUBLE AS confidence,
  CASE WHEN p_partkey % 2 = 0 AND a.i = 0 THEN true END AS matched FROM part, (VALUES (0), (1)) a(i)""")
def normaliser_replies(spark: SparkSession, d: str) -> DataFrame:
    """Every other reply has an object too few, so its values pass as they are, numbers as nothing."""
    first = F.format_string('{"value": "%s", "matched_allowed": true, "confidence": 7}', "p_brand")
    reply = F.concat(F.lit("["), first, F.when(F.col("k") % 2 == 0, F.lit(', {"value": "null"}')).otherwise(""), F.lit("]"))
    kinds = F.array(F.struct(F.lit(0).alias("attr_idx"), F.lit("string").alias("type")), F.struct(F.lit(1).alias("attr_idx"), F.lit("number").alias("type")))
    asked = _parts(spark, d).select("product_id", F.explode(kinds).alias("a")).select("product_id", "a.*", F.lit("raw").alias("raw"), F.lit("kg").alias("unit"))
    return replies.normalised(asked, _parts(spark, d).select("product_id", reply.alias("reply"))).drop("unit")


@query("SELECT p_partkey AS product_id, 0 AS attr_idx, p_type AS label FROM part WHERE p_partkey % 2 = 0")
def model_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels that do not exist are dropped, and all of a reply that has not one object for each attribute."""
    p = _parts(spark, d)
    reply = F.concat(F.lit('[{"label": "'), "p_type", F.lit('"}, {"label": "no such label"}'), F.when(F.col("k") % 2 == 0, F.lit(', {"label": null}')).otherwise(""), F.lit("]"))
    return replies.label_matches(_attrs(spark, d), p.select("product_id", reply.alias("reply")), p.select("product_id", F.col("p_type").alias("label")))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Sizes given one too high, names, and truths, with every tenth missing."""
    value = _by(3, F.format_string("about %d mm", F.col("p_size") + 1), F.col("p_name"), F.when(F.col("p_size") > 25, "Yes").otherwise("ні"))
    numbers = F.array(F.col("p_size").cast("double"), F.lit(30.0))
    return _parts(spark, d).select("product_id", F.when(F.col("k") % 10 != 0, value).alias("value"), _by(3, F.lit("number"), F.lit("contains"), F.lit("boolean")).alias("kind"), numbers.alias("numbers"), F.array(F.lit("STEEL"), F.upper(F.substring_index("p_name", " ", 1))).alias("needles"), F.lit(True).alias("truth"))


_CHECK_SQL = """
WITH c AS (SELECT p_partkey AS product_id, p_partkey % 10 <> 0 AS found, p_partkey % 10 <> 0 AND CASE p_partkey % 3
  WHEN 0 THEN abs(p_size + 1 - p_size) <= p_size * 0.02 + 1e-9 OR abs(p_size + 1 - 30) <= 0.6 + 1e-9
  WHEN 1 THEN contains(lower(p_name), 'steel') OR contains(lower(p_name), lower(split_part(p_name, ' ', 1))) ELSE p_size > 25 END AS correct FROM part)"""


@query(_CHECK_SQL + " SELECT * FROM c")
def check_answers(spark: SparkSession, d: str) -> DataFrame:
    return benchmark.checked(_answers(spark, d)).select("product_id", "found", "correct")


@query(_CHECK_SQL + """ SELECT count(*)::BIGINT AS total, sum(correct::INT)::BIGINT AS correct, sum(found::INT)::BIGINT AS found,
  round(100 * avg(correct::INT), 6)::DOUBLE AS correct_pct, round(100 * avg(found::INT), 6)::DOUBLE AS found_pct FROM c""")
def benchmark_score(spark: SparkSession, d: str) -> DataFrame:
    return benchmark.score(benchmark.checked(_answers(spark, d)))


def _spec_pages(spark: SparkSession, d: str) -> DataFrame:
    """Three pairs a part: in a table, definitions, a list, hinted rows of a container, linked data, or application state."""
    three = lambda form: F.concat(*[F.format_string(form, F.lit(n), F.col(c).cast("string")) for n, c in (("Maker", "p_brand"), ("Kind", "p_type"), ("Size", "p_size"))])
    listed = lambda form: F.concat_ws(",", *[F.format_string(form, F.lit(n), F.col(c).cast("string")) for n, c in (("Maker", "p_brand"), ("Kind", "p_type"), ("Size", "p_size"))])
    body = _by(
        6,
        F.concat(F.lit("<table>"), three("<tr><td>%s</td><td>%s</td></tr>"), F.lit("</table>")),
        F.concat(F.lit("<dl>"), three("<dt>%s</dt><dd>%s</dd>"), F.lit("</dl>")),
        F.concat(F.lit("<ul>"), three("<li>%s: %s</li>"), F.lit("</ul>")),
        F.concat(F.lit('<div class="product-params">'), three('<div><span class="label">%s</span><span>%s</span></div>'), F.lit("</div>")),
        F.concat(F.lit('<script type="application/ld+json">{"@type":"Product","additionalProperty":['), listed('{"name":"%s","value":"%s"}'), F.lit("]}</script>")),
        F.concat(F.lit('<script type="application/json">{"a":{"b":['), listed('{"name":"%s","value":"%s"}'), F.lit("]}}</script>")),
    )
    nav = F.lit("<nav><ul><li>a1: b</li><li>c1: d</li><li>e1: f</li></ul></nav><h2>Main data</h2>")
    return _page(spark, d, F.concat(F.lit("https://shop.example/"), F.col("k").cast("string")), F.concat(F.lit("<html><body>"), nav, body, F.lit("</body></html>")))


@query("""
SELECT p_partkey AS page_id, ['table', 'dl', 'list', 'div', 'jsonld', 'state'][p_partkey % 6 + 1] AS extractor, CASE WHEN p_partkey % 6 < 4 THEN 'Main data' ELSE 'Specifications' END AS grp,
  v.n AS name, CASE v.n WHEN 'Maker' THEN p_brand WHEN 'Kind' THEN p_type ELSE p_size::VARCHAR END AS value FROM part, (VALUES ('Maker'), ('Kind'), ('Size')) v(n)""")
def page_specs(spark: SparkSession, d: str) -> DataFrame:
    return html.extract_specs(_spec_pages(spark, d)).select("page_id", "extractor", "grp", "name", "value")


@query("""
SELECT p_partkey AS page_id, 'https://shop.example/' || p_partkey || '/specs' AS link, 24::INT AS score, 1::INT AS rank FROM part WHERE p_partkey % 3 <> 2
UNION ALL SELECT p_partkey, 'https://shop.example/data', 10, CASE WHEN p_partkey % 3 <> 2 THEN 2 ELSE 1 END FROM part""")
def page_spec_links(spark: SparkSession, d: str) -> DataFrame:
    """A link to specifications, to a data sheet, to another host, to itself and to reviews; every third page has no first one."""
    first = F.when(F.col("k") % 3 != 2, F.format_string('<a href="/%d/specs">Technical Specifications</a>', "k")).otherwise("")
    rest = F.format_string('<a href="/data#x">Data sheet</a><a href="https://else.example/s">Specs</a><a href="/%d">Specs</a><a href="/r">Specs review</a>', "k")
    return html.spec_links(_page(spark, d, F.concat(F.lit("https://shop.example/"), F.col("k").cast("string")), F.concat(first, rest))).select("page_id", "link", "score", "rank")


@query("""
WITH t AS (SELECT p_partkey AS text_id, p_brand AS b, p_size::VARCHAR AS s, p_type AS t, 'Brand: ' || p_brand || chr(10) || 'Size, mm: ' || p_size || ' | Type: ' || p_type AS text FROM part)
SELECT text_id, v.n AS raw_label, CASE v.i WHEN 0 THEN b WHEN 1 THEN s ELSE t END AS raw_value, 'structured' AS kind, (instr(text, v.n) - 1)::INT AS char_start, (instr(text, v.n) - 1 + length(v.n))::INT AS char_end,
  substr(text, instr(text, v.n), 200) AS snippet FROM t, (VALUES (0, 'Brand'), (1, 'Size, mm'), (2, 'Type')) v(i, n)""")
def claim_evidence(spark: SparkSession, d: str) -> DataFrame:
    made = table(spark, d, "part").select(F.col("p_partkey").alias("text_id"), F.format_string("Brand: %s\nSize, mm: %d | Type: %s", "p_brand", "p_size", "p_type").alias("text"))
    return resolve.claims_from_text(made).drop("seq")


@query("""
SELECT p_partkey AS product_id, p_partkey % 8 IN (0, 7) AS safe FROM part""")
def address_safety(spark: SparkSession, d: str) -> DataFrame:
    hosts = ("https://shop.example/%d", "http://127.0.0.1/%d", "http://10.1.2.3/%d", "http://192.168.0.9/%d", "http://169.254.169.254/%d", "ftp://shop.example/%d", "http://localhost/%d", "http://8.8.8.8/%d")
    return _parts(spark, d).select("product_id", urls.is_safe(_by(8, *[F.format_string(h, "k") for h in hosts])).alias("safe"))


@query("SELECT p_partkey AS page_id, p_name || ' ' || p_type || ' & ' || p_brand AS text FROM part")
def made_page_text(spark: SparkSession, d: str) -> DataFrame:
    page = F.format_string("<html><head><style>p {}</style></head><body><script>var x = '<p>';</script><h1>%s</h1>\n <p>%s &amp; <b>%s</b></p></body></html>", "p_name", "p_type", "p_brand")
    return _parts(spark, d).select(F.col("k").alias("page_id"), text.page_text(page).alias("text"))


@query("SELECT p_partkey AS product_id, v.a AS attr, v.l AS label FROM part, (VALUES ('Brand', 'Maker'), ('Colour', 'Paint')) v(a, l)")
def semantic_labels(spark: SparkSession, d: str) -> DataFrame:
    """Vectors are clear for Brand, tied for Colour, where reranking decides, and under the floor for Weight."""
    vectors = {"Maker": [3.0, 0.0, 0.0], "Brand": [2.0, 0.2, 0.0], "Tint": [0.0, 1.0, 0.0], "Paint": [0.0, 1.0, 0.02], "Colour": [0.0, 5.0, 0.05], "Weight": [1.0, 1.0, 1.0], "Lost": [0.0, 0.0, 0.0]}
    provider = TableProvider(spark.createDataFrame(list(vectors.items()), "text string, vector array<double>"), spark.createDataFrame([("Colour", "Tint", 0.2), ("Colour", "Paint", 0.9)], "attr string, label string, rerank double"))
    labels = _parts(spark, d).select("product_id", F.explode(F.array(*map(F.lit, ("Maker", "Tint", "Paint", "Lost", "Unknown")))).alias("label"))
    return matching.semantic_labels(_attrs(spark, d, ("Brand", "Colour", "Weight")), labels, provider)


@query("""
SELECT p_partkey AS product_id, q.i::INT AS query_idx, CASE q.i WHEN 0 THEN p_brand || ' ' || p_name || ' specifications' WHEN 1 THEN p_brand || ' ' || p_name || ' характеристики'
  ELSE p_brand || ' ' || p_name || ' site:hotline.ua OR site:rozetka.com.ua OR site:ek.ua' END AS query FROM part, (VALUES (0), (1), (2)) q(i) WHERE p_partkey % 2 = 0
UNION ALL SELECT p_partkey, q.i::INT, CASE q.i WHEN 0 THEN 'site:maker.example "' || p_name || '"' ELSE 'site:maker.example ' || p_brand || ' ' || p_name || ' specifications' END FROM part, (VALUES (0), (1)) q(i) WHERE p_partkey % 2 = 1""")
def spec_queries(spark: SparkSession, d: str) -> DataFrame:
    p = _parts(spark, d).select("product_id", F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), *[F.lit(None).cast("string").alias(c) for c in ("category", "article", "mpn", "ean13", "upc")])
    official = p.where("product_id % 2 = 1").select("product_id", F.lit("maker.example").alias("domain"))
    return ranking.spec_queries(p, official)


@query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS ts, (event_id % 7) * 5000.0 AS took, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, event_id, i, ts::DOUBLE AS went, -1e18::DOUBLE AS a, (ts + took)::DOUBLE AS b FROM e WHERE i = 1
  UNION ALL SELECT user_id, event_id, i, went, least(b, went + took), greatest(b, went + took) FROM (
    SELECT e.user_id, e.event_id, e.i, e.took, greatest(e.ts, f.went + 3600, f.a) AS went, f.b FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1))
SELECT event_id, round(went, 3)::DOUBLE AS "at" FROM f""")
def paced_slots(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.col("user_id").cast("string").alias("client"), ((F.col("event_id") % 7) * 5000.0).alias("took"))
    return stateful.paced_slots(e, ["client"], 3600.0).select("event_id", F.round("at", 3).alias("at"))
