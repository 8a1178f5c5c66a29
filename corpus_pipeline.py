"""The training-text pipeline: quality rules, near-duplicates, decontamination, mixing, token shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next stage's docs. All but the last return docs' own columns, for the rows that stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm import decontamination, mixing, near_dup, quality_rules, token_shards
from specloom.llm.common import cut, documents


def _where(docs: DataFrame, decided: DataFrame, keys: list[tuple[str, Column]]) -> DataFrame:
    """Rows of docs that `decided` names by keys, whatever columns docs has."""
    names = [f"__key{i}" for i in range(len(keys))]
    left = docs.withColumns({n: c for n, (_, c) in zip(names, keys, strict=True)})
    right = decided.select(*[F.col(k).alias(f"{n}r") for n, (k, _) in zip(names, keys, strict=True)]).distinct()
    on = F.lit(True)
    for n in names:
        on = on & F.col(n).eqNullSafe(F.col(f"{n}r"))
    return left.join(right, on, "left_semi").drop(*names)


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang", "source")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null, empty and short texts fail the base rules and go; a very long text is judged whole. Rows with one id
    are one document: all are kept if one is, and rows without an id if one of those is.
    """
    return quality_rules.kept_rows(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8): the one of the smallest id.

    Rows with one id are one document, of which one row stays: the first by a digest of its text. Texts
    without words, null ones and rows without an id are near to nothing and stay.
    """
    kept = cut(near_dup.near_dup(_slim(docs)).where("kept").select("doc_id"), "pipeline-dedup")
    out = _where(docs, kept, [("doc_id", F.col("doc_id"))])
    several = cut(kept.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("__id")), "pipeline-repeated")
    if several.isEmpty():
        return out
    names = [f"`{c}`" for c in docs.columns]
    again = out.join(several, F.col("doc_id") == F.col("__id"), "left_semi")
    first = again.groupBy("doc_id").agg(F.min_by(F.struct(*names), F.xxhash64("text")).alias("__row")).select("__row.*")
    return out.join(several, F.col("doc_id") == F.col("__id"), "left_anti").unionByName(first.select(*names))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, wherever in a text it stands.

    All rows of an id go if one holds a passage; null and empty texts hold none. An empty benchmark takes nothing.
    """
    found = decontamination.decontamination(_slim(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = found.select(F.col("doc_id").alias("__leak")).distinct()
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col("__leak")), "left_anti")


def balance(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, to the nearest whole number.

    In a shard of the mix all documents but one are taken a whole number of times, so a source strays from its
    blocks by half a document a shard at most. Documents without words are taken zero times. Rows with one id
    are each taken as often as the one that is taken most.
    """
    size = F.col("size")
    times = F.when(size > 0, F.round(F.col("taken") / size)).otherwise(0).cast("int")
    drawn = mixing.mix(_slim(docs)).groupBy("doc_id").agg(F.max(times).alias("__times")).withColumnRenamed("doc_id", "__id")
    out = docs.join(drawn.where("__times > 0"), F.col("doc_id").eqNullSafe(F.col("__id")))
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[f"`{c}`" for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token shards say of each row: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts are their end id alone; rows of one id come in the order of a digest of their texts.
    """
    return token_shards.token_shards(_slim(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", rules),
    ("near duplicates", dedup),
    ("decontamination", decontaminate),
    ("mixing", balance),
    ("token shards", tokens),
]

#: The alignment, the hashing and the tokenizer are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
