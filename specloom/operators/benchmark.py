"""Scoring answers against what is expected of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The share by which a number may be off, and words that say yes.
TOLERANCE = 0.02
TRUE = ("true", "yes", "так", "да", "є", "1")


def number_fits(value: Column, expected: Column, tolerance: float = TOLERANCE) -> Column:
    """Whether the first number of the value is one of the expected array, each give or take its tolerance."""
    first = F.replace(F.nullif(F.regexp_extract(value, r"-?\d+(?:[.,]\d+)?", 0), F.lit("")), F.lit(","), F.lit(".")).cast("double")
    return F.coalesce(F.exists(expected, lambda t: F.abs(first - t) <= F.abs(t) * tolerance + 1e-9), F.lit(False))


def holds_any(value: Column, needles: Column) -> Column:
    """Whether one of the needles stands in the value, whatever its case."""
    low = F.replace(F.lower(value), F.lit("‑"), F.lit("-"))
    return F.coalesce(F.exists(needles, lambda n: F.contains(low, F.lower(n))), F.lit(False))


def truth_is(value: Column, expected: Column) -> Column:
    """Whether the value says yes where that is expected, else something other than yes."""
    low = F.trim(F.lower(value))
    yes = low.isin(*TRUE) | F.contains(low, F.lit("так")) | F.contains(low, F.lit("yes"))
    return F.coalesce((low != "") & (yes == expected), F.lit(False))


def checked(answers: DataFrame) -> DataFrame:
    """answers (value, kind, numbers array<double>, needles array<string>, truth boolean) with `correct` and `found`."""
    ok = F.when(F.col("kind") == "number", number_fits(F.col("value"), F.col("numbers"))).when(F.col("kind") == "contains", holds_any(F.col("value"), F.col("needles"))).when(F.col("kind") == "boolean", truth_is(F.col("value"), F.col("truth")))
    return answers.withColumns({"found": F.coalesce(F.col("value"), F.lit("")) != "", "correct": F.coalesce(ok, F.lit(False))})


def score(checked_answers: DataFrame) -> DataFrame:
    """(total, correct, found, correct_pct, found_pct) of checked answers."""
    share = lambda c: F.coalesce(F.round(100 * F.avg(F.col(c).cast("double")), 6), F.lit(0.0))
    count = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0).cast("long"))
    return checked_answers.agg(F.count("*").alias("total"), count("correct").alias("correct"), count("found").alias("found"), share("correct").alias("correct_pct"), share("found").alias("found_pct"))
