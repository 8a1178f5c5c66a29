"""Line deduplication: explode normalised lines, hash, count documents per hash, drop, reassemble by position."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm.common import SPACE_CHARS, ascii_lower, documents, lean, limit_batches

#: Stands for a null doc_id where documents are compared.
NO_ID = -(1 << 63)


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, d, th, pos): every line with a key of at least min_chars code points."""
    key = ascii_lower(F.btrim("line", F.lit(SPACE_CHARS)))
    return (
        docs.select("d", "th", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select("d", "th", "pos", key.alias("key"))
        .where(F.length("key") >= min_chars)
        .select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), "d", "th", "pos")
    )


@lean
def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, drops, out = b.column("text").to_pylist(), b.column("drops").to_pylist(), {"n_lines": [], "n_dropped": [], "kept_text": []}
        for text, drop in zip(texts, drops, strict=True):
            lines = text.split("\n")
            gone = set(drop or ())
            out["n_lines"].append(len(lines))
            out["n_dropped"].append(len(gone))
            out["kept_text"].append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text)
        cols = [b.column("doc_id"), pa.array(out["n_lines"], pa.int64()), pa.array(out["n_dropped"], pa.int64()), pa.array(out["kept_text"], pa.string())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_lines", "n_dropped", "kept_text"])


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Return (doc_id, n_lines, n_dropped, kept_text), one row for each row of docs.

    A line's key is the line without ASCII white space at its ends and with A-Z in lower case. A key of at
    least min_chars code points that min_docs documents or more hold loses all its lines, but for those in the
    largest doc_id that holds it. Null and empty texts are one empty line. Rows with one doc_id count as one
    document; a null doc_id counts as one document below all others. Other columns are ignored.

    Documents are counted in two steps, per (hash, document) and then per hash with partial sums, so a line
    that a third of all documents share is never gathered; the join that finds the lines to drop has one row
    for each hash on one side, so a skewed partition of lines can be split. Only positions of dropped lines
    are gathered per document, and they are bounded by its own lines. Keys meet as 128-bit hashes.
    """
    limit_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.xxhash64(text).alias("th"), text.alias("text"))
    lines = _lines(rows, min_chars)
    held = lines.groupBy("h1", "h2", "d").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("d").alias("keeper"))
    drops = lines.join(held.where(F.col("n") >= min_docs).drop("n"), ["h1", "h2"]).where(F.col("d") != F.col("keeper")).groupBy("d", "th").agg(F.collect_set("pos").alias("drops"))
    return rows.join(drops, ["d", "th"], "left").select("doc_id", "text", "drops").mapInArrow(_rebuild, "doc_id long, n_lines long, n_dropped long, kept_text string")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
g AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT k.doc_id, count(*)::BIGINT AS n_lines,
       count(*) FILTER (WHERE g.key IS NOT NULL AND k.doc_id <> g.keeper)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(k.line, chr(10) ORDER BY k.pos)
              FILTER (WHERE g.key IS NULL OR k.doc_id = g.keeper), '')) AS kept_sha256
FROM k LEFT JOIN g ON k.key = g.key
GROUP BY k.doc_id
"""
