"""Mixing sources to target weights: equal-token blocks apportioned by Sainte-Lague, then seeded block selection.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specloom.llm.common import cut, documents, mark, n_words

#: A source's documents are dealt over shards of about this many words, or rows where texts are short, so that no task orders a whole source.
SHARD_WORDS, SHARD_ROWS = 4_000_000, 250_000
BLOCK_WORDS = 16
WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source, null a source of its own.

    Sources in code point order, null last, weigh as `weights`, repeating, and share the sum of all sizes.
    A target stops at `most` times its source's size and the excess is shared again by weight until none is
    above. The fixed point is found in closed form: with sources by cap over weight, the level at which the
    rest are filled evenly is (total - caps so far) / weights left. The windows read one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("i", (F.row_number().over(order) - 1) % len(weights)).withColumn("weight", F.element_at(F.array(*[F.lit(x) for x in weights]), F.col("i") + 1))
    w = w.withColumn("cap", (F.lit(most) * F.col("source_size")).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    every, before = Window.partitionBy(), by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumns({"total": F.sum(F.col("source_size").cast("double")).over(every), "caps": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "left": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    level = (F.col("total") - F.col("caps")) / F.col("left")
    w = w.withColumns({"at": F.row_number().over(by_ratio), "level": level})
    w = w.withColumn("level", F.min_by("level", F.when(F.col("level") <= F.col("ratio"), F.col("at"))).over(every))
    return w.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap")).alias("target"))


def apportion(votes: DataFrame, keys: list[str], unit: Column, seats: str) -> DataFrame:
    """Sainte-Lague within each group of `keys`: add quota to (keys..., v, cap, seats), highest v / (2 q + 1) first.

    `unit` orders equal quotients. A quota stops at cap; what no unit can take is left over. The divisor that
    fills the seats lies between sum / (seats + k / 2) and sum / (seats - k / 2) for k units, so the quotas at
    the lower end are given at once and only the few quotients between both ends are ranked.
    """
    group = Window.partitionBy(*keys)
    v = votes.withColumns({"u": unit, "sum_v": F.sum("v").over(group), "k": F.count("*").over(group)})
    low = F.greatest(F.lit(0.0), F.ceil(F.try_divide(F.col("v") * (F.col(seats) - F.col("k") / 2 - 1), F.col("sum_v")) - 0.5))
    high = F.ceil(F.try_divide(F.col("v") * (F.col(seats) + F.col("k") / 2 + 1), F.col("sum_v")) + 0.5)
    v = v.withColumns({"q0": F.least(F.coalesce(low, F.lit(0.0)).cast("long"), F.col("cap")), "q1": F.least(F.coalesce(high, F.lit(0.0)).cast("long"), F.col("cap"))})
    v = v.withColumn("open", F.col(seats) - F.sum("q0").over(group))
    more = v.where(F.col("q1") > F.col("q0")).select(*keys, "u", "open", "v", F.explode(F.sequence("q0", F.col("q1") - 1)).alias("q"))
    best = Window.partitionBy(*keys).orderBy((F.col("v") / (2 * F.col("q") + 1)).desc(), F.col("u"))
    won = more.withColumn("r", F.row_number().over(best)).where(F.col("r") <= F.col("open")).groupBy(*keys, "u").agg(F.count("*").alias("won"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "u"]]
    on = same[0]
    for x in same[1:]:
        on = on & x
    out = v.alias("a").join(won.alias("b"), on, "left")
    return out.select("a.*", (F.col("a.q0") + F.coalesce("b.won", F.lit(0))).alias("quota")).drop("u", "sum_v", "k", "q0", "q1", "open")


def mix(docs: DataFrame, seed: int = 7, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, shard_rows: int = SHARD_ROWS, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Return (doc_id, size, source_size, target, taken), one row for each row of docs.

    size is the number of words. Each source's words are dealt by a seeded hash over shards of about
    shard_words words or shard_rows rows; blocks of block_words words are apportioned to the sources by their targets and then to
    each source's shards by their words, both by highest quotients. A shard is the endless repetition of its
    documents in seeded order, and its quota is that many whole blocks from the start: full repeats and then a
    seeded part. taken is what of it falls in the document, at most `most` times its size.

    Null and blank texts have size 0 and take nothing; a null source is a source of its own, ordered last;
    repeated rows and null ids are rows like others. An empty table gives no rows. Only (doc_id, source,
    size) is shuffled, never a text; each task orders one shard.
    """
    rows = cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("digest")), "mix-sizes")
    sources = mark(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("rows")))
    totals = mark(source_targets(sources.select("source", "source_size"), weights, most))
    blocks = totals.withColumns({"v": F.col("target"), "cap": F.floor(F.lit(most) * F.col("source_size") / block_words), "one": F.lit(1)})
    blocks = blocks.withColumn("seats", F.round(F.sum("target").over(Window.partitionBy("one")) / block_words).cast("long"))
    blocks = apportion(blocks, ["one"], F.struct(F.col("source").isNull(), "source"), "seats").withColumnRenamed("quota", "source_blocks")
    shards = F.greatest(F.lit(1), F.ceil(F.col("b.source_size") / shard_words), F.ceil(F.col("s.rows") / shard_rows)).cast("long")
    blocks = mark(blocks.alias("b").join(sources.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select("b.source", "b.source_size", "target", "source_blocks", shards.alias("shards")))
    dealt = F.xxhash64(F.lit(seed), "doc_id", "size", "digest")
    told = rows.alias("r").join(blocks.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.*", "s.source_size", "s.target", "s.source_blocks", F.pmod(dealt, F.col("s.shards")).alias("shard"))
    placed = told.where("size > 0")
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("words"), F.first("source_blocks").alias("source_blocks"))
    shards = shards.withColumns({"v": F.col("words").cast("double"), "cap": F.floor(F.lit(most) * F.col("words") / block_words)})
    quotas = apportion(shards, ["source"], F.col("shard"), "source_blocks").select("source", "shard", "words", (F.col("quota") * block_words).alias("quota_words"))
    drawn = F.xxhash64(F.lit(seed + 1), "doc_id", "size", "digest")
    order = Window.partitionBy("source", "shard").orderBy(drawn, "doc_id", "size", "digest")
    ends = placed.withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    same = F.col("e.source").eqNullSafe(F.col("q.source")) & (F.col("e.shard") == F.col("q.shard"))
    whole = F.expr("q.quota_words div q.words")
    part = F.least(F.col("e.size"), F.greatest(F.lit(0), F.pmod(F.col("q.quota_words"), F.col("q.words")) - (F.col("e.end") - F.col("e.size"))))
    taken = (whole * F.col("e.size") + part).cast("long")
    drawn_rows = ends.alias("e").join(quotas.alias("q"), same).select("e.doc_id", "e.size", "e.source_size", "e.target", taken.alias("taken"))
    return drawn_rows.unionByName(told.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))
