"""Numbers with units: scanning texts, converting between units, rendering."""

from __future__ import annotations

from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Dimension -> unit -> factor to the dimension's base.
DIMENSIONS: dict[str, dict[str, float]] = {
    "data": {"b": 1, "kb": 1e3, "mb": 1e6, "gb": 1e9, "tb": 1e12},
    "freq": {"hz": 1, "khz": 1e3, "mhz": 1e6, "ghz": 1e9},
    "time": {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1, "min": 60, "h": 3600},
    "len": {"nm": 1e-9, "um": 1e-6, "µm": 1e-6, "mm": 1e-3, "cm": 1e-2, "m": 1, "inch": 0.0254, "in": 0.0254, '"': 0.0254, "″": 0.0254},
    "mass": {"mg": 1e-3, "g": 1, "kg": 1e3, "t": 1e6},
    "vol": {"ml": 1e-3, "cl": 1e-2, "l": 1},
    "power": {"w": 1, "kw": 1e3},
    "volt": {"mv": 1e-3, "v": 1},
    "current": {"ma": 1e-3, "a": 1},
    "energy": {"wh": 1, "kwh": 1e3},
    "charge": {"mah": 1, "ah": 1e3},
    "byterate": {"b/s": 1, "kb/s": 1e3, "mb/s": 1e6, "gb/s": 1e9},
    "bitrate": {"bps": 1, "kbps": 1e3, "mbps": 1e6, "gbps": 1e9, "bit/s": 1, "kbit/s": 1e3, "mbit/s": 1e6, "gbit/s": 1e9},
    "rot": {"rpm": 1},
    "sound": {"db": 1, "dba": 1},
    "press": {"bar": 1, "kpa": 0.01, "mpa": 10, "psi": 0.0689476},
    "temp": {"°c": 1},
    "tempf": {"°f": 1},
    "ppm": {"ppm": 1},
    "dpi": {"dpi": 1},
    "flow": {"l/min": 60, "l/h": 1},
    "gflow": {"g/min": 1},
    "lum": {"nits": 1, "cd/m2": 1, "cd/m²": 1},
    "mpix": {"mp": 1},
}
UNITS = {u: (d, float(f)) for d, us in DIMENSIONS.items() for u, f in us.items()}

#: Unit -> its other spellings in English, Ukrainian and Russian.
SPELLINGS: dict[str, tuple[str, ...]] = {
    "inch": ("inches", "дюйм", "дюйми", "дюймів", "дюймов", "дюйма"),
    "hz": ("hertz", "гц"),
    "khz": ("кгц",),
    "mhz": ("мгц",),
    "ghz": ("ггц",),
    "g": ("grams", "г", "гр"),
    "kg": ("kilograms", "кг"),
    "mg": ("мг",),
    "mm": ("мм",),
    "cm": ("см",),
    "m": ("м",),
    "l": ("л", "литр", "литра", "литров", "літр", "літра", "літрів", "liter", "liters", "litre", "litres"),
    "ml": ("мл",),
    "w": ("вт", "watt", "watts"),
    "kw": ("квт", "kwatt"),
    "v": ("в", "вольт"),
    "a": ("amps",),
    "ma": ("milliamps",),
    "rpm": ("об/хв", "об/мин", "r/min", "1/min", "об/min", "rev/min", "оборотов/мин", "обертів/хв"),
    "db": ("дб", "дба", "db(a)"),
    "bar": ("бар",),
    "kpa": ("кпа",),
    "mpa": ("мпа",),
    "gb": ("гб",),
    "mb": ("мб",),
    "tb": ("тб",),
    "kb": ("кб",),
    "l/min": ("л/хв", "л/мин"),
    "l/h": ("л/год", "л/ч", "l/hr"),
    "g/min": ("г/хв", "г/мин"),
    "ppm": ("стор/хв", "стр/мин", "pages/min", "ipm", "pages/minute", "сторінок/хв", "аркушів/хв", "страниц/мин"),
    "mah": ("мач",),
    "wh": ("втгод",),
    "s": ("с", "сек"),
    "min": ("хв", "мин"),
    "h": ("год", "ч"),
    "ms": ("мс",),
    "°c": ("°с", "℃", "градусів", "градусов"),
    "nits": ("nit",),
    "cd/m2": ("кд/м2", "кд/м²"),
}
ALIASES = {a: u for u, names in SPELLINGS.items() for a in names}

#: Signs that may begin a unit beside letters, go on in it, and end it; dashes of ranges; words before an upper end.
UNIT_FIRST, UNIT_NEXT, UNIT_LAST = "µ°″℃\"", "µ°″\"²/·.()", "²″\")"
DASHES, UPPER_WORDS = "-–—…", ("макс", "max", "до")
PAIRS = T.ArrayType(T.StructType([T.StructField("num", T.DoubleType()), T.StructField("unit", T.StringType()), T.StructField("dim", T.StringType()), T.StructField("factor", T.DoubleType())]))


def canonical(unit: str) -> str:
    u = unit.strip().lower().strip(".,;:()").translate(str.maketrans("", "", "· ."))
    return ALIASES.get(u, u)


def _letter(c: str) -> bool:
    """Latin letters, and those of Ukrainian and Russian."""
    return c.isalpha() and (c.isascii() or "а" <= c.lower() <= "я" or c.lower() in "іїєґ")


def _ungrouped(s: str) -> str:
    """Without the spaces and commas that part thousands: a digit before, three after, and no fourth."""

    def parts(i: int) -> bool:
        three, then = s[i + 1 : i + 4], s[i + 4 : i + 5]
        return s[i - 1].isdecimal() and len(three) == 3 and three.isdecimal() and not then.isdecimal() and (s[i].isspace() or then != ",")

    return "".join(c for i, c in enumerate(s) if not ((c == "," or c.isspace()) and i and parts(i)))


def _skip(s: str, i: int) -> int:
    while i < len(s) and s[i].isspace():
        i += 1
    return i


def _figure(s: str, i: int) -> int:
    """The end of the number that begins at i: digits, and a fraction after a point or a comma."""
    j = i + (s[i] == "-")
    while j < len(s) and s[j].isdecimal():
        j += 1
    k = j + 1
    while j < len(s) and s[j] in ".," and k < len(s) and s[k].isdecimal():
        k += 1
    return k if k > j + 1 else j


def _upper_end(s: str, i: int) -> int | None:
    """Where the upper end of a range begins, if a dash and no more than "max." lie between i and it."""
    i = _skip(s, i)
    if i >= len(s) or s[i] not in DASHES:
        return None
    i = _skip(s, i + 1)
    word = next((w for w in UPPER_WORDS if s[i : i + len(w)].lower() == w), "")
    i += len(word)
    i = _skip(s, i + (word not in ("", "до") and s[i : i + 1] == "."))
    return i if i < len(s) and s[i].isdecimal() else None


def _upper_ends(s: str) -> str:
    """Without the lower ends of ranges, which begin where no other number goes on."""
    out, i = [], 0
    while i < len(s):
        begins = (s[i].isdecimal() or s[i] == "-" and s[i + 1 : i + 2].isdecimal()) and not (i and (s[i - 1].isdecimal() or s[i - 1] in ".,"))
        upper = _upper_end(s, _figure(s, i)) if begins else None
        if upper is None:
            out.append(s[i])
        i = i + 1 if upper is None else upper
    return "".join(out)


def _unit_end(s: str, i: int) -> int:
    """The end of what may be a unit at i: from a letter or a sign on to the last letter, digit or closing sign."""
    if i >= len(s) or not (_letter(s[i]) or s[i] in UNIT_FIRST):
        return i
    j = i + 1
    while j < len(s) and (_letter(s[j]) or s[j] in UNIT_NEXT or s[j] in "0123456789"):
        j += 1
    while j > i + 1 and not (_letter(s[j - 1]) or s[j - 1] in UNIT_LAST or s[j - 1].isdecimal()):
        j -= 1
    return j


def scan(text: str | None) -> list[tuple[float, str | None]]:
    """(number, unit or None) in reading order.

    Of a range the upper end counts. Digits after a letter, a dash, an underscore or a slash belong to a name;
    so do digits with two letters or more glued to them that are no unit.
    """
    s, out, i = _upper_ends(_ungrouped(text or "")), [], 0
    before = ""
    while i < len(s):
        signed = s[i] == "-" and s[i + 1 : i + 2].isdecimal()
        if not signed and not s[i].isdecimal():
            before, i = s[i], i + 1
            continue
        end = _figure(s, i)
        start = _skip(s, end)
        stop = _unit_end(s, start)
        named = before != "" and (before.isalpha() or before in "-_/")
        unit = canonical(s[start:stop]) if stop > start else None
        glued = unit is not None and unit not in UNITS and start == end and len(unit) >= 2
        if not named and not glued:
            out.append((float(s[i:end].replace(",", ".")), unit if unit in UNITS else None))
        i = stop if stop > start else end
        before = s[i - 1]
    return out


@F.pandas_udf(PAIRS)
def number_units(s: pd.Series) -> pd.Series:
    return s.map(lambda t: [dict(zip(("num", "unit", "dim", "factor"), (n, u, *UNITS.get(u, (None, None))), strict=True)) for n, u in scan(t)])


def _table(pairs: dict[str, object]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs.items())])


def canonical_unit(c: Column) -> Column:
    u = F.translate(F.btrim(F.lower(F.trim(c)), F.lit(".,;:()")), "· .", "")
    return F.coalesce(F.try_element_at(_table(ALIASES), u), u)


def dimension(unit: Column) -> Column:
    return F.try_element_at(_table({u: d for u, (d, _) in UNITS.items()}), unit)


def factor(unit: Column) -> Column:
    return F.try_element_at(_table({u: f for u, (_, f) in UNITS.items()}), unit)


def label_unit(label: Column) -> Column:
    """The known unit at the end of a label: "Weight, kg", "Power (kW)"."""
    found = F.regexp_extract(F.trim(label), r"[,(/]\s*([a-zA-Zа-яіїєґА-ЯІЇЄҐµ°″\"][a-zA-Zа-яіїєґА-ЯІЇЄҐµ°″\"²/·.0-9]{0,10})\s*\)?\s*$", 1)
    unit = canonical_unit(found)
    return F.when((found != "") & dimension(unit).isNotNull(), unit)


def has_unit(pairs: Column) -> Column:
    return F.exists(pairs, lambda p: p["unit"].isNotNull())


def render(x: Column) -> Column:
    """A number as text: whole numbers without a point, others with six significant digits."""
    digits = F.least(F.lit(6), F.greatest(F.lit(0), F.lit(5) - F.floor(F.log10(F.abs(x))).cast("int")))
    short = F.round(x * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", short), r"0+$", ""), r"\.$", "")
    return F.when(x == F.floor(x), x.cast("decimal(38,0)").cast("string")).otherwise(text)


def to_integer(raw: Column, pairs: Column) -> Column:
    """The first number cut to an integer; null for texts of over 200 characters."""
    return F.when(F.length(raw) <= 200, F.get(pairs, 0)["num"].cast("bigint").cast("string"))


def to_number(pairs: Column, target: Column) -> Column:
    """struct(value, unit, confidence): converted from the first figure of the target's dimension (0.92), else the first figure as it is (0.6), or 0.85 without a known target."""
    unit = canonical_unit(target)
    dim, first = dimension(unit), F.get(pairs, 0)
    same = F.get(F.filter(pairs, lambda p: p["dim"] == dim), 0)
    out = lambda v, u, c: F.struct(v.alias("value"), u.alias("unit"), F.lit(c).alias("confidence"))
    converted = out(render(same["num"] * same["factor"] / factor(unit)), target, 0.92)
    assumed, plain = out(render(first["num"]), target, 0.6), out(render(first["num"]), first["unit"], 0.85)
    return F.when(F.size(pairs) > 0, F.when(dim.isNotNull() & same.isNotNull(), converted).when(dim.isNotNull(), assumed).otherwise(plain))
