"""Sources and sinks: tables of pages, search results and texts; caches as JSON; providers of models."""

from __future__ import annotations

import tempfile
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.functions.text import fetch_allowed, within_size

PRODUCT = "product_id long, name string, category string, brand string, article string, mpn string, ean13 string, upc string"
ATTRIBUTE = "product_id long, attr_idx int, name string, type string, unit string, allowed array<string>"
RESULT = "product_id long, query_idx int, pos int, url string, title string, content string, score double"


def read(spark: SparkSession, path: str, kind: str | None = None, schema: str | None = None) -> DataFrame:
    """A table in parquet, orc, csv or json, by its ending unless kind says so."""
    r = spark.read.format(kind or path.rstrip("/").rsplit(".", 1)[-1])
    r = r.option("header", True)
    return (r.schema(schema) if schema else r).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists") -> None:
    df.write.format(kind).mode(mode).save(path)


def fetched(pages: DataFrame) -> DataFrame:
    """Pages that may be used: of bounded size, and not closed to robots where a header says so."""
    df = pages.where(within_size(F.col("html")))
    return df.where(fetch_allowed(F.col("robots"))) if "robots" in pages.columns else df


def with_titles(urls: DataFrame, titles: DataFrame) -> DataFrame:
    return urls.join(titles, "url", "left").withColumn("title", F.coalesce("title", F.lit("")))


def first_boxes(responses: DataFrame, column: str) -> DataFrame:
    """Of each product the first response whose list is not empty."""
    return responses.where(F.size(column) > 0).groupBy("product_id").agg(F.min_by(column, "query_idx").alias(column))


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept in the folder of checkpoints, so that plans built on it stay small and survive lost executors.

    The folder is the session's; where spark.checkpoint.dir names none, a session on one machine gets a temporary one.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="specloom-checkpoint-"))
    return df.checkpoint()


class Provider(Protocol):
    """What models give, as DataFrames; without one the deterministic steps stand alone."""

    def embed(self, texts: DataFrame) -> DataFrame:
        """(text, vector) with vectors of length 1."""

    def rerank(self, pairs: DataFrame) -> DataFrame:
        """(attr, label, rerank)."""

    def normalise(self, values: DataFrame) -> DataFrame:
        """(product_id, attr_idx, value, unit, matched, confidence)."""


class TableProvider:
    """A provider whose models have answered beforehand: vectors (text, vector), scores (attr, label, rerank), replies (product_id, reply).

    What a table lacks is what a model that failed gives: nothing.
    """

    def __init__(self, vectors: DataFrame | None = None, scores: DataFrame | None = None, replies: DataFrame | None = None):
        self.vectors, self.scores, self.replies = vectors, scores, replies

    def embed(self, texts: DataFrame) -> DataFrame:
        """(text, vector) of length 1; a vector of zeros has no direction and counts as none."""
        v = texts.select("text").distinct().join(self.vectors, "text")
        norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
        return v.withColumn("_n", norm).where("_n > 0").select("text", F.transform("vector", lambda x: x / F.col("_n")).alias("vector"))

    def rerank(self, pairs: DataFrame) -> DataFrame:
        return pairs.select("attr", "label").distinct().join(self.scores, ["attr", "label"])

    def normalise(self, values: DataFrame) -> DataFrame:
        from specloom.sources import replies

        return replies.normalised(values, self.replies)


def parse_reply(reply: str) -> Column:
    """A model's answer as a variant, without the fence around it; null where it is no JSON."""
    return F.try_parse_json(F.trim(F.regexp_replace(F.col(reply), r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")))
