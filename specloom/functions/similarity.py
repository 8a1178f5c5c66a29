"""Similarity of labels and values: token rules natively, character ratios in Arrow batches."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specloom.functions.text import label_key

#: Unit words of labels, and words that say nothing of what is measured.
UNIT_WORDS = "kg g mm cm m l ml w kw v hz khz mhz ghz gb mb tb ms s min h db bar rpm ppm dpi inch inches кг г мм см м л мл вт квт в гц дб бар дюйм дюймів".split()
STOP_WORDS = "of the a an for in max maximum min minimum макс максимальна максимальний максимальная максимальный мін мин".split()


def ratio_of(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching characters of both texts over all, in the order given (the measure is not symmetric)."""
    return pd.Series([None if x is None or y is None else ratio_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def core_tokens(key: Column) -> Column:
    """Distinct words of a label key without stop words, and without unit words unless nothing else is left."""
    t = F.array_distinct(F.filter(F.split(key, " "), lambda x: (x != "") & ~x.isin(*STOP_WORDS)))
    core = F.filter(t, lambda x: ~x.isin(*UNIT_WORDS))
    return F.when(F.size(core) > 0, core).otherwise(t)


def token_floor(ka: Column, kb: Column, ta: Column, tb: Column) -> Column:
    """What words alone vouch for: 0.8 if one key contains the other, 0.95, 0.85 or 0.6 + 0.35 * Jaccard by token sets."""
    inside = F.when(F.contains(ka, kb) | F.contains(kb, ka), 0.80).otherwise(0.0)
    shared, union = F.size(F.array_intersect(ta, tb)), F.size(F.array_union(ta, tb))
    least = F.least(F.size(ta), F.size(tb))
    sets = F.when(least == 0, 0.0).when(shared == union, 0.95).when(shared == least, 0.85).when(shared > 0, 0.6 + 0.35 * shared / union).otherwise(0.0)
    return F.greatest(inside, sets)


def length_bound(ka: Column, kb: Column) -> Column:
    """No character ratio is higher."""
    a, b = F.length(ka), F.length(kb)
    return 2 * F.least(a, b) / F.greatest(F.lit(1), a + b)


def key_similarity(ka: Column, kb: Column, ta: Column, tb: Column) -> Column:
    """0 to 1 for two label keys and their words."""
    score = F.greatest(token_floor(ka, kb, ta, tb), ratio(ka, kb))
    return F.when((ka == "") | (kb == ""), 0.0).when(ka == kb, 1.0).otherwise(score)


def label_similarity(a: Column, b: Column) -> Column:
    """0 to 1, for the label a of a page and the wanted name b."""
    ka, kb = label_key(a), label_key(b)
    return key_similarity(ka, kb, core_tokens(ka), core_tokens(kb))
