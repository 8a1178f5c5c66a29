"""Text predicates and normalisers as native column expressions, with Unicode classes throughout."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABEL_MAX, VALUE_MAX, TEXT_MAX, BODY_MAX = 100, 1500, 8000, 3_000_000


def strip(c: Column, chars: str = r"\s") -> Column:
    """Without any of the characters of a regex class at both ends."""
    return F.regexp_replace(c, rf"(?U)^[{chars}]+|[{chars}]+\z", "")


def squeeze(c: Column) -> Column:
    """White space of any kind and length to one space, none at the ends."""
    return F.btrim(F.regexp_replace(c, r"(?U)[\s\p{Z}]+", " "))


def present(c: Column) -> Column:
    """Null for the empty text: the data model treats both alike."""
    return F.nullif(c, F.lit(""))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda t: t != "")


def lower_words_only(c: Column) -> Column:
    """Lower case, everything but letters, digits, underscores and spaces to a space."""
    return squeeze(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " "))


def label_key(c: Column) -> Column:
    """A label for comparison: one kind of apostrophe, no parentheses, no punctuation, lower case."""
    plain = F.translate(F.lower(c), "’`ʼ", "'''")
    return lower_words_only(F.regexp_replace(plain, r"\([^)]*\)", " "))


def facet_like(c: Column) -> Column:
    """A list of filter values: eight tokens or more, five numbers or more, at most two different words between them."""
    t = words(c)
    number = lambda x: x.rlike(r"^-?\d+([.,]\d+)?$")
    others = F.array_distinct(F.transform(F.filter(t, lambda x: ~number(x)), lambda x: F.btrim(F.lower(x), F.lit(".,;:()"))))
    return (F.size(t) >= 8) & (F.size(F.filter(t, number)) >= 5) & (F.size(others) <= 2)


def valid_pair(label: Column, value: Column) -> Column:
    n, v = F.length(label), F.length(value)
    return F.coalesce((label != value) & (n > 1) & (n < LABEL_MAX) & (v > 0) & (v < VALUE_MAX) & ~facet_like(value), F.lit(False))


def looks_html(c: Column) -> Column:
    """Begins with a tag and has a structural one among its first 5000 characters."""
    t = F.regexp_replace(c, r"(?U)^\s+", "")
    return t.startswith("<") & F.substring(t, 1, 5000).rlike(r"(?i)<(table|html|body|div|ul|dl|section|script|article)\b")


def page_text(html: Column) -> Column:
    """Readable text: tags with what only machines or menus read are dropped, at most TEXT_MAX characters."""
    skipped = reduce(lambda c, tag: F.regexp_replace(c, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " "), ("script", "style", "nav", "footer", "header", "aside", "noscript"), html)
    bare = F.regexp_replace(F.regexp_replace(skipped, r"(?s)<!--.*?-->", " "), r"<[^>]+>", " ")
    known = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
    return F.substring(squeeze(reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), known, bare)), 1, TEXT_MAX)


def within_size(html: Column) -> Column:
    return F.octet_length(html) <= BODY_MAX


def fetch_allowed(robots: Column) -> Column:
    """Whether a robots header lets the page be used."""
    r = F.lower(F.coalesce(robots, F.lit("")))
    return ~r.contains("noindex") & (F.trim(r) != "none")


def text_cells(text: Column) -> Column:
    """The cells of each line in order: lines cut at " | "."""
    return F.flatten(F.transform(F.split(text, r"\R"), lambda line: F.split(line, r" \| ")))


#: A cell "Label: value" with 2 to 70 characters before the colon.
PAIR = r"^\s*([^:\n]{2,70})\s*[:：]\s*(\S.{0,300})$"

#: What UTF-8 read as Latin-1 looks like.
MOJIBAKE = ("Ã", "Â", "â€", "â\x80", "Ð", "Ñ", "Å", "ð\x9f")


def mojibake_count(c: Column) -> Column:
    return reduce(lambda a, m: a + (F.length(c) - F.length(F.replace(c, F.lit(m), F.lit("")))) / len(m), MOJIBAKE, F.lit(0.0)).cast("int")


_HIGH = re.compile(r"[\x80-\xff]{2,}")
_BLANK = re.compile("[ \t\u00a0\u200b]+")


def _decoded(m: re.Match) -> str:
    try:
        return m.group().encode("latin-1").decode("utf-8")
    except UnicodeDecodeError:
        return m.group()


def repair_one(s: str | None) -> str:
    """Undo UTF-8 read as Latin-1, run by run and only where the bytes are UTF-8; compose; tidy white space."""
    s = unicodedata.normalize("NFC", _HIGH.sub(_decoded, s or ""))
    return "\n".join(x for x in (_BLANK.sub(" ", y).strip() for y in s.split("\n")) if x)


@F.pandas_udf(T.StringType())
def repair(s: pd.Series) -> pd.Series:
    return s.map(repair_one)
