"""What models answer, as tables of replies: values of a page, labels that mean attributes, normalised values.

A provider of models may fill these tables; without one they are empty, and the deterministic steps stand alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.sources.tables import parse_reply

KEYS = ["product_id", "attr_idx"]


def _field(reply: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(reply, f"$.{name}", kind)


def _said(c: Column) -> Column:
    return F.when((F.coalesce(c, F.lit("")) != "") & (c != "null"), c)


def extracted(replies: DataFrame) -> DataFrame:
    """Candidates of (product_id, attr_idx, page_rank, url, title, reply): values that were found, confidence in [0, 0.85], 0.7 where none is told."""
    r = replies.withColumn("_r", parse_reply("reply"))
    told, conf = _field(F.col("_r"), "confidence"), _field(F.col("_r"), "confidence", "double")
    value = _field(F.col("_r"), "value")
    found = _field(F.col("_r"), "found", "boolean") & (F.coalesce(value, F.lit("")) != "") & (told.isNull() | conf.isNotNull())
    sure = F.greatest(F.lit(0.0), F.least(F.lit(0.85), F.when(F.coalesce(conf, F.lit(0.0)) == 0, 0.7).otherwise(conf)))
    return r.where(found).select(*KEYS, "page_rank", value.alias("value"), _field(F.col("_r"), "unit").alias("unit"), sure.alias("confidence"), F.lit("llm").alias("method"), "url", "title", value.alias("raw_value"))


def _listed(asked: DataFrame, replies: DataFrame) -> DataFrame:
    """asked with `_r`, the element of its product's reply at its place; none where the reply has not one for each."""
    cols = [c for c in asked.columns if c != "product_id"]
    per = asked.groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct("attr_idx", *[c for c in cols if c != "attr_idx"]))).alias("_a"))
    got = replies.select("product_id", F.try_variant_get(parse_reply("reply"), "$", "array<variant>").alias("_l"))
    j = per.join(got, "product_id", "left").withColumn("_fits", F.coalesce(F.size("_l") == F.size("_a"), F.lit(False)))
    j = j.select("product_id", "_fits", "_l", F.posexplode("_a").alias("_i", "_x"))
    return j.select("product_id", "_x.*", "_fits", F.when(F.col("_fits"), F.get("_l", F.col("_i"))).alias("_r"))


def normalised(asked: DataFrame, replies: DataFrame) -> DataFrame:
    """(product_id, attr_idx, value, unit, matched, confidence) for asked (product_id, attr_idx, type, raw, unit).

    replies: (product_id, reply), a list with an object for each asked value in order; confidence in [0, 1],
    0.6 where none is told. Where the list does not fit, raw values pass at 0.5, numbers as nothing at 0.
    """
    r = _listed(asked, replies)
    conf = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(_field(F.col("_r"), "confidence", "double"), F.lit(0.6))))
    kept = F.when(~F.col("type").isin("number", "integer"), F.nullif(F.col("raw"), F.lit("")))
    pick = lambda a, b: F.when(F.col("_fits"), a).otherwise(b)
    return r.select(
        *KEYS,
        pick(_said(_field(F.col("_r"), "value")), kept).alias("value"),
        pick(_said(_field(F.col("_r"), "unit")), F.when(kept.isNotNull(), F.col("unit"))).alias("unit"),
        F.when(F.col("_fits"), _field(F.col("_r"), "matched_allowed", "boolean")).alias("matched"),
        pick(conf, F.when(kept.isNotNull(), 0.5).otherwise(0.0)).alias("confidence"),
    )


def label_matches(asked: DataFrame, replies: DataFrame, labels: DataFrame) -> DataFrame:
    """(product_id, attr_idx, label): labels that a reply gives asked attributes (product_id, attr_idx) and that exist (product_id, label)."""
    named = _listed(asked.select(*KEYS), replies).select(*KEYS, _field(F.col("_r"), "label").alias("label")).where("label is not null")
    return named.join(labels.select("product_id", "label").distinct(), ["product_id", "label"], "left_semi").select(*KEYS, "label")
