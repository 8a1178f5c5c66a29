"""Pools of specifications and the attributes that are looked for in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom import catalog
from specloom.config import DEFAULTS, EngineConfig
from specloom.functions.quantity import label_unit, number_units
from specloom.functions.similarity import core_tokens, key_similarity, length_bound, token_floor
from specloom.functions.text import PAIR, label_key, lower_words_only, repair, squeeze, text_cells
from specloom.sources.tables import Provider


def text_pool(texts: DataFrame) -> DataFrame:
    """(text_id, seq, name, value): cells "Label: value" in order, the first of each lower-cased label and value."""
    cells = texts.select("text_id", F.posexplode(text_cells(F.col("text"))).alias("seq", "cell")).where(F.col("cell").rlike("[:：]"))
    pair = cells.withColumn("cell", repair("cell")).withColumn("cell", squeeze(F.col("cell")))
    pair = pair.select("text_id", "seq", F.trim(F.regexp_extract("cell", PAIR, 1)).alias("name"), F.trim(F.regexp_extract("cell", PAIR, 2)).alias("value"))
    return keep_first(pair.where("name <> '' and value <> '' and name <> value"), ["text_id", F.lower("name"), "value"])


def keep_first(df: DataFrame, keys: list, order: str = "seq") -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_r = 1").drop("_r")


def by_key(left: DataFrame, right: DataFrame, keys: str | list[str], how: str = "inner") -> DataFrame:
    """A join of tables that both grow with the products. Their files can be far smaller than their rows (exploded, or
    of repeated words), and a size guessed from files would have Spark collect one on the driver: both sides are dealt out."""
    return left.join(right.hint("merge"), keys, how)


def pool_labels(pool: DataFrame) -> DataFrame:
    """(product_id, label, label_seq): distinct labels by first sight."""
    return pool.groupBy("product_id", F.col("name").alias("label")).agg(F.min("seq").alias("label_seq"))


def with_label_unit(pool: DataFrame) -> DataFrame:
    """pool with the unit of the label carried on to values without one, as full_value."""
    df = pool.withColumn("_pairs", number_units("value")).withColumn("_unit", label_unit(F.col("name")))
    bare = F.col("_unit").isNotNull() & ~F.exists("_pairs", lambda p: p["unit"].isNotNull())
    return df.withColumn("full_value", F.when(bare, F.concat_ws(" ", "value", "_unit")).otherwise(F.col("value"))).drop("_pairs", "_unit")


def confidence_of(sim: Column) -> Column:
    return F.when(sim >= 0.92, 0.88).when(sim >= 0.82, 0.80).otherwise(0.72)


def fuzzy_labels(attrs: DataFrame, labels: DataFrame, threshold: float = DEFAULTS.pool_match) -> DataFrame:
    """(product_id, attr_idx, label, sim): similarity join within a product over distinct labels."""
    pairs = by_key(attrs.select("product_id", "attr_idx", F.col("name").alias("attr")), labels.select("product_id", "label"), "product_id")
    return pairs.join(similar(pairs, threshold), ["label", "attr"]).select("product_id", "attr_idx", "label", "sim")


def similar(pairs: DataFrame, threshold: float) -> DataFrame:
    """(label, attr, sim) of the pairs at or above threshold; each distinct pair is measured once.

    A native bound (shared words, containment, lengths) keeps hopeless pairs away from the character ratio.
    """
    d = pairs.select("label", "attr").distinct().withColumns({"ka": label_key(F.col("label")), "kb": label_key(F.col("attr"))})
    d = d.withColumns({"ta": core_tokens(F.col("ka")), "tb": core_tokens(F.col("kb"))})
    keys = [F.col(c) for c in ("ka", "kb", "ta", "tb")]
    able = F.greatest(token_floor(*keys), length_bound(*keys[:2])) >= threshold
    return d.where(able).withColumn("sim", key_similarity(*keys)).where(F.col("sim") >= threshold).select("label", "attr", "sim")


def groups_of(phrases: DataFrame, column: str) -> DataFrame:
    """(column, grp): groups of a phrase: by equality, else by words that contain or are contained, weak words alone apart."""
    spark = phrases.sparkSession
    table = catalog.synonyms(spark)
    keys = phrases.select(column).distinct().withColumn("phrase", lower_words_only(F.col(column)))
    exact = keys.join(F.broadcast(table.drop("words")), "phrase").select(column, "grp")
    rest = keys.join(exact.select(column).distinct(), column, "left_anti").withColumn("w", F.array_distinct(F.split("phrase", " ")))
    known = table.select(F.col("words").alias("kw"), "grp", F.explode("words").alias("t"))
    shared = rest.select(column, "w", F.explode("w").alias("t")).join(F.broadcast(known), "t").select(column, "w", "kw", "grp").distinct()
    both = F.array_intersect("w", "kw")
    within = F.size(both) == F.least(F.size("w"), F.size("kw"))
    strong = F.size(F.array_except(both, F.array(*map(F.lit, catalog.WEAK_WORDS)))) > 0
    return exact.unionByName(shared.where(within & strong).select(column, "grp").distinct())


def synonym_labels(attrs: DataFrame, labels: DataFrame) -> DataFrame:
    """(product_id, attr_idx, label): the first label of a product that shares a synonym group with the attribute."""
    pairs = by_key(attrs.select("product_id", "attr_idx", F.col("name").alias("attr")), labels, "product_id")
    names = pairs.select("attr", "label").distinct()
    shared = names.join(groups_of(names, "attr"), "attr").join(groups_of(names, "label"), ["label", "grp"]).select("attr", "label").distinct()
    return pairs.join(shared, ["attr", "label"]).groupBy("product_id", "attr_idx").agg(F.min_by("label", "label_seq").alias("label"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def ann_scores(attrs: DataFrame, labels: DataFrame, keys: list[str] | None = None, top: int = DEFAULTS.rerank_top, itself: bool = True, places: int = 9) -> DataFrame:
    """(attr, label, score, place) of the `top` best labels of each attribute within a key, the larger label first among equals.

    Without a key, attrs (attr, av) is a stated set of queries that goes in blocks past all labels (label, lv);
    itself=False leaves out the label of the attribute's own name. Each task keeps `top` pairs an attribute
    before the shuffle, so what moves grows with the queries and the tasks, not with the pairs. Scores are
    rounded to `places`, so that equal vectors tie whatever order they are summed in.
    """
    on = [*(keys or []), "attr"]
    pairs = attrs.join(labels, keys) if keys else labels.join(F.broadcast(attrs))
    pairs = pairs if itself else pairs.where(F.col("attr") != F.col("label"))
    order = Window.partitionBy(*on).orderBy(F.col("score").desc(), F.col("label").desc())
    scored = pairs.select(*on, "label", F.round(dot(F.col("av"), F.col("lv")), places).alias("score"))
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)


def ann_match(scores: DataFrame, rerank: DataFrame | None = None, keys: list[str] | None = None, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """(attr, label): the best label where it is good enough and clear of the next, or where reranking a near tie leads."""
    on = [*(keys or []), "attr"]
    w = Window.partitionBy(*on).orderBy("place")
    led = scores.withColumn("next", F.coalesce(F.lead("score").over(w), F.lit(-1.0)))
    top = led.where("place = 1").where(F.col("score") >= cfg.ann_accept)
    clear = top.where(F.col("score") - F.col("next") >= cfg.ann_margin).select(*on, "label")
    if rerank is None:
        return clear
    tied = scores.join(top.join(clear, on, "left_anti").select(*on), on).where((F.col("place") <= cfg.rerank_top) & (F.col("score") >= cfg.ann_accept - cfg.ann_margin))
    again = tied.join(rerank, [*on, "label"])
    v = Window.partitionBy(*on).orderBy(F.col("rerank").desc(), "place")
    again = again.withColumns({"r": F.row_number().over(v), "then": F.lead("rerank").over(v)})
    good = F.coalesce(F.col("rerank") - F.col("then") >= cfg.rerank_lead, F.lit(True)) & (F.col("score") >= cfg.ann_accept)
    return clear.unionByName(again.where("r = 1").where(good).select(*on, "label"))


def semantic_labels(attrs: DataFrame, labels: DataFrame, provider: Provider, rerank: bool = True, cfg: EngineConfig = DEFAULTS) -> DataFrame:
    """(product_id, attr, label): labels that mean an attribute by a provider's vectors, near ties by its reranking."""
    names = attrs.select(F.col("name").alias("text")).unionByName(labels.select(F.col("label").alias("text")))
    v = provider.embed(names)
    a = attrs.select("product_id", F.col("name").alias("attr")).join(v.select(F.col("text").alias("attr"), F.col("vector").alias("av")), "attr")
    b = labels.select("product_id", "label").join(v.select(F.col("text").alias("label"), F.col("vector").alias("lv")), "label")
    scores = ann_scores(a, b, ["product_id"], cfg.rerank_top)
    again = scores.select("product_id", "attr", "label").join(provider.rerank(scores.select("attr", "label")), ["attr", "label"]) if rerank else None
    return ann_match(scores, again, ["product_id"], cfg)


def label_candidates(matched: DataFrame, pool: DataFrame) -> DataFrame:
    """(product_id, attr_idx, seq, value, unit, confidence, method, url, title, raw_value, tier, part) of all pool rows with a matched label.

    matched: (product_id, attr_idx, label, confidence, part).
    """
    rows = by_key(matched, with_label_unit(pool).withColumnRenamed("name", "label"), ["product_id", "label"])
    return rows.select("product_id", "attr_idx", "seq", F.col("full_value").alias("value"), F.lit(None).cast("string").alias("unit"), "confidence", F.lit("css_selector").alias("method"), "url", "title", F.col("full_value").alias("raw_value"), F.lit(0).alias("tier"), "part")


#: Words of an axis, and letters that stand for one.
AXES = {"width": ("ширина", "width"), "height": ("висота", "высота", "height"), "depth": ("глибина", "глубина", "depth")}
LETTERS = {"ш": "width", "в": "height", "г": "depth", "w": "width", "h": "height", "d": "depth", "t": "depth"}


def dimension_candidates(attrs: DataFrame, pool: DataFrame) -> DataFrame:
    """Candidates for one axis from a value of three figures whose label states the order of axes."""
    low = F.lower("name")
    axis = F.coalesce(*[F.when(F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(F.lower("attr"), w)), k) for k, ws in AXES.items()])
    a = attrs.select("product_id", "attr_idx", F.col("name").alias("attr")).withColumn("axis", axis).where("axis is not null")
    order = r"([швгwhdt])\s*[x×х*]\s*([швгwhdt])\s*[x×х*]\s*([швгwhdt])"
    letters = F.create_map(*[F.lit(x) for kv in LETTERS.items() for x in kv])
    axes = F.array(*[F.try_element_at(letters, F.regexp_extract(low, order, g)) for g in (1, 2, 3)])
    p = pool.where(low.rlike("(?iu)габарит|розмір|размер|dimension") & low.rlike(order)).withColumns({"axes": axes, "nums": F.regexp_extract_all("value", F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0))})
    j = by_key(a, p, "product_id").withColumn("at", F.array_position("axes", F.col("axis"))).where((F.col("at") > 0) & (F.size("nums") >= 3))
    unit = F.coalesce(F.nullif(F.regexp_extract("value", r"(?iuU)\b(мм|см|mm|cm)\b", 1), F.lit("")), label_unit(F.col("name")))
    value = F.concat_ws(" ", F.element_at("nums", F.col("at").cast("int")), unit)
    return j.select("product_id", "attr_idx", "seq", value.alias("value"), F.lit(None).cast("string").alias("unit"), F.lit(0.72).alias("confidence"), F.lit("css_selector").alias("method"), "url", "title", F.concat_ws(": ", "name", "value").alias("raw_value"))


def infobox_candidates(attrs: DataFrame, boxes: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Candidates from (product_id, box_idx, url, title, attributes): labels alike to 0.75, better from 0.9 on."""
    from specloom.functions.similarity import ratio

    rows = boxes.select("product_id", "box_idx", "url", "title", F.posexplode("attributes").alias("pos", "a")).select("product_id", "box_idx", "pos", "url", "title", F.col("a.label").alias("label"), F.col("a.value").alias("value"))
    j = attrs.select("product_id", "attr_idx", F.col("name").alias("attr")).join(rows, "product_id").withColumn("sim", ratio(F.trim(F.lower("label")), F.trim(F.lower("attr")))).where(F.col("sim") >= threshold)
    return j.select("product_id", "attr_idx", F.struct("box_idx", "pos").alias("seq"), "value", F.lit(None).cast("string").alias("unit"), F.when(F.col("sim") >= 0.9, 0.95).otherwise(0.85).alias("confidence"), F.lit("infobox").alias("method"), "url", "title", F.col("value").alias("raw_value"))


def answer_candidates(attrs: DataFrame, answers: DataFrame) -> DataFrame:
    """Candidates from answers that hold a digit and a word of the attribute."""
    j = attrs.select("product_id", "attr_idx", F.col("name").alias("attr")).join(answers, "product_id")
    told = F.exists(F.split(F.lower("attr"), r"\s+"), lambda t: (t != "") & F.contains(F.lower("answer"), t)) & F.col("answer").rlike(r"\d")
    return j.where(told).select("product_id", "attr_idx", F.col("pos").alias("seq"), F.col("answer").alias("value"), F.lit(0.70).alias("confidence"), F.lit("infobox").alias("method"))


def _places(text: Column, term: Column) -> Column:
    """First characters, from 1 on, of all places of term in text that do not overlap."""
    between = F.split(text, F.concat(F.lit("\\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1)
    step = lambda s, x: F.struct((s["end"] + F.length(x) + F.length(term)).alias("end"), F.concat(s["at"], F.array(s["end"] + F.length(x) + 1)).alias("at"))
    none = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("at"))
    return F.aggregate(F.slice(between, F.lit(1), F.size(between) - 1), none, step)["at"]


def focused_text(text: Column, attribute: Column, window: int = 2500) -> Column:
    """The window around a mention of the attribute that has most digits, the first of equals; else the last 5000 characters.

    Mentions are all places of the attribute, then those of its words of more than 3 characters.
    """
    low = F.lower(text)
    terms = F.array_distinct(F.concat(F.array(F.lower(attribute)), F.filter(F.split(F.lower(attribute), r"\s+"), lambda t: F.length(t) > 3)))
    start = lambda i: F.greatest(F.lit(1), i - window // 2)
    chunk = lambda i: F.substring(text, start(i), i + window // 2 - start(i))
    hits = F.flatten(F.transform(F.filter(terms, lambda t: t != ""), lambda t: _places(low, t)))
    scored = F.transform(hits, lambda i, k: F.struct((-F.length(F.regexp_replace(chunk(i), r"\D", ""))).alias("n"), k.alias("k"), i.alias("i")))
    return F.when(F.size(hits) > 0, chunk(F.array_min(scored)["i"])).otherwise(F.right(text, F.lit(5000)))
