"""Coercing raw values to a type, snapping to allowed values, cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.functions.quantity import number_units, to_integer, to_number
from specloom.functions.text import repair, strip, words

#: Words that answer yes or no.
YES = ("yes", "true", "✓", "present", "supported", "available", "+", "є", "так", "да", "есть")
NO = ("no", "false", "✗", "—", "-", "absent", "unsupported", "n/a", "none", "немає", "нет", "ні", "відсутній", "відсутня", "отсутствует")
NEGATION = r"(?iuU)\b(no|not|none|without|немає|нема|ні|відсутн\w*|нет|отсутств\w*|бе[зс])\b"
#: What is stripped from the ends of a value, and words of a name that echo nothing.
_EDGE = r"\s,;:\-—–"
NO_ECHO = ("of", "the", "a", "type", "size")


def to_boolean(raw: Column) -> Column:
    """ "true" or "false" by the first word or the whole, by a negation, else true for a short text with a letter."""
    low = strip(F.lower(raw))
    first = F.btrim(F.get(words(low), 0), F.lit(".,;:"))
    yes, no = first.isin(*YES) | low.isin(*YES), first.isin(*NO) | low.isin(*NO)
    return F.when(low == "", None).when(yes, "true").when(no | low.rlike(NEGATION), "false").when((F.length(low) <= 80) & low.rlike(r"\p{L}"), "true")


def snap(raw: Column, allowed: Column) -> Column:
    """The allowed value that raw equals, in list order, or the longest that it holds as a whole word; else null."""
    low = F.lower(raw)
    equal = F.get(F.filter(allowed, lambda o: F.lower(o) == strip(low)), 0)
    ranked = F.array_sort(F.transform(allowed, lambda o, i: F.struct((-F.length(o)).alias("n"), i.alias("i"), o.alias("o"))))
    edge = "[a-zа-яіїєґ0-9]"
    inside = F.get(F.filter(ranked, lambda x: F.rlike(low, F.concat(F.lit(rf"(?<!{edge})\Q"), F.lower(x["o"]), F.lit(rf"\E(?!{edge})")))), 0)["o"]
    return F.coalesce(equal, inside)


def segment(value: Column, attribute: Column) -> Column:
    """Of several qualified figures the one whose words share a stem with the attribute and which has a number of its own."""
    parts = F.filter(F.split(value, r"(?U)\s*[|;•]\s*|\s{3,}|,\s+(?=[^\d\s])"), lambda s: strip(s) != "")
    stems = F.transform(F.filter(F.regexp_extract_all(F.lower(attribute), F.lit("[a-zа-яіїєґ]+"), F.lit(0)), lambda w: F.length(w) >= 5), lambda w: F.substring(w, 1, 5))
    hit = F.get(F.filter(parts, lambda s: s.rlike(r"(?U)(?<!\w)\d") & F.exists(stems, lambda st: F.contains(F.lower(s), st))), 0)
    return F.when(F.size(parts) >= 2, F.coalesce(strip(hit), value)).otherwise(value)


#: What ends a value and begins fine print or the next section.
TAIL = r"(?is)\s*(?:https?://|\bplease\s+refer\b|\bplease\s+visit\b|\bfor\s+more\s+information\b|\bsupported\s+memory\s+types\b|\*\s*\S).*\z"
SIDES = (("rear", "front"), ("front", "rear"), ("back", "front"), ("internal", "external"), ("external", "internal"))
DISPLAY_UNIT = r'(?i)\d+(?:[.,]\d+)?\s*(TB|GB|MB|KB|GHz|MHz|kHz|Hz|ms|mm|cm|nm|kg|g|nits|cd/m2|px|bit|kW|W|V|A|"|°C|°|inch|inches|rpm|dB|bar|ppm|dpi|ml|l|об/хв|об/мин|кг|г|л|мл|кВт|Вт|дБ|бар|мм|см|Гц|ГГц|МГц)'


def display_unit(value: Column) -> Column:
    """The first unit that follows a number, as it is written."""
    return F.nullif(F.regexp_extract(value, rf"(?uU){DISPLAY_UNIT}\b", 1), F.lit(""))


def _one_side(v: Column, attribute: Column) -> Column:
    """Where the attribute asks for one side and the value goes on to the other, the value up to there."""
    low, out = F.lower(v), v
    for side, other in reversed(SIDES):
        at, own = F.instr(low, other), F.instr(low, side)
        cut = F.contains(F.lower(attribute), F.lit(side)) & (own > 0) & (at > own) & (at > 11)
        out = F.when(cut, strip(F.substring(v, F.lit(1), at - 1), r"\s,;\-—–")).otherwise(out)
    return out


def _no_echo(v: Column, attribute: Column) -> Column:
    """Without the attribute's own words at the end, unless nothing is left."""
    own = F.filter(F.regexp_extract_all(F.lower(attribute), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: ~t.isin(*NO_ECHO))
    w = words(v)
    said = F.transform(w, lambda t: F.array_contains(own, F.btrim(F.lower(t), F.lit(".,;:-"))))
    last = F.coalesce(F.array_max(F.filter(F.transform(said, lambda s, i: F.when(s, -1).otherwise(i)), lambda i: i >= 0)), F.lit(-1))
    head = strip(F.array_join(F.slice(w, 1, last + 1), " "), _EDGE)
    return F.when((F.size(own) == 0) | (head == ""), v).otherwise(head)


def cleaned(df: DataFrame, value: str, attribute: str, out: str) -> DataFrame:
    """Add a value's head: first line, without fine print, the other side, glued dimensions, an echo of the attribute and leading symbols."""
    a, v = F.col(attribute), F.col(out)
    df = df.withColumn(out, repair(F.col(value)))
    df = df.withColumn(out, strip(F.regexp_replace(strip(F.substring_index(v, "\n", 1)), TAIL, ""), _EDGE))
    df = df.withColumn(out, _one_side(v, a))
    before = strip(F.regexp_extract(v, r"(?is)^(.{3,}?)\d+(?:[.,]\d+)?\s*(?:inch|inches|in|cm|mm)\b.*x", 1), r"\s,;:\-—–(")
    df = df.withColumn(out, F.when(before != "", before).otherwise(v))
    df = df.withColumn(out, _no_echo(v, a))
    return df.withColumn(out, strip(F.regexp_replace(v, r"(?U)^[\s\p{S}\p{M}\x{FE0F}•‣◦·]+", "")))


def coerced(df: DataFrame, out: str = "coerced") -> DataFrame:
    """Add struct(value, unit, matched, confidence) of (type, raw, name, unit, allowed), or null where only a model could tell.

    Numbers, integers and booleans are snapped to allowed values where there are any; an enumeration, or a
    text with allowed values, is nothing but snapped, and has no unit then. The two Arrow functions stand in
    projections of their own, so that the native part reads their results once.
    """
    df = df.withColumn("_part", segment(F.col("raw"), F.col("name"))).withColumn("_pairs", number_units("_part"))
    df = cleaned(df, "raw", "name", "_text").withColumn("_number", to_number(F.col("_pairs"), F.col("unit")))
    kind, text, number, unit, allowed = (F.col(c) for c in ("type", "_text", "_number", "unit", "allowed"))
    listed = F.coalesce(F.size(allowed) > 0, F.lit(False))
    value = F.when(kind == "integer", to_integer(F.col("_part"), F.col("_pairs"))).when(kind == "number", number["value"]).when(kind == "boolean", to_boolean(F.col("raw")))
    value = F.when(kind.isin("integer", "number", "boolean"), value).otherwise(text)
    long = F.when(F.length(text) > 120, 0.4).when(F.length(text) > 80, 0.6).otherwise(0.85)
    only = (kind == "enum") | ((kind == "string") & listed)
    df = df.withColumns({
        "_value": value,
        "_unit": F.when(kind == "number", number["unit"]).when(~kind.isin("integer", "boolean"), display_unit(text)),
        "_conf": F.when(kind == "number", number["confidence"]).when(kind.isin("integer", "boolean"), 0.9).otherwise(long),
        "_only": only,
    })
    df = df.withColumn("_snapped", snap(F.when(F.col("_only"), F.col("raw")).otherwise(F.col("_value")), allowed))
    row = lambda v, u, m, c: F.struct(v.alias("value"), u.alias("unit"), m.cast("boolean").alias("matched"), c.cast("double").alias("confidence"))
    snapped, own = F.col("_snapped"), F.coalesce("_unit", "unit")
    result = (
        F.when(F.col("_only"), F.when(snapped.isNotNull(), row(snapped, F.lit(None).cast("string"), F.lit(True), F.lit(0.9))))
        .when(F.col("_value").isNull() | (F.btrim("_value") == ""), F.lit(None))
        .when(listed, F.when(snapped.isNotNull(), row(snapped, own, F.lit(True), F.col("_conf"))))
        .otherwise(row(F.col("_value"), own, F.lit(None), F.col("_conf")))
    )
    return df.withColumn(out, result).drop("_part", "_pairs", "_text", "_number", "_value", "_unit", "_conf", "_only", "_snapped")
