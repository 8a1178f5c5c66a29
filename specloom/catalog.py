"""Static dimension tables as small DataFrames; their size is fixed by this file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Points of well structured and of useless domains.
QUALITY = {"techpowerup.com": 5.0, "gsmarena.com": 5.0, "notebookcheck.net": 4.0, "anandtech.com": 4.0, "rtings.com": 4.0, "displayspecifications.com": 4.0, "kimovil.com": 3.0, "versus.com": 2.0, "rozetka.com.ua": 3.5, "hotline.ua": 3.0, "ek.ua": 3.0, "e-katalog.ru": 2.0, "comfy.ua": 2.5, "moyo.ua": 2.5, "foxtrot.com.ua": 2.5, "allo.ua": 2.0, "eldorado.ua": 2.0}
JUNK = {"youtube.com": -25.0, "facebook.com": -25.0, "instagram.com": -25.0, "tiktok.com": -25.0, "pinterest.com": -20.0, "x.com": -20.0, "twitter.com": -20.0, "reddit.com": -10.0, "quora.com": -10.0, "aliexpress.com": -6.0, "ebay.com": -6.0, "olx.ua": -12.0}

#: A table of our own: makers' sites, the first of each the main one.
BRANDS = {
    "asus": ("asus.com", "rog.asus.com"),
    "msi": ("msi.com",),
    "gigabyte": ("gigabyte.com", "aorus.com"),
    "samsung": ("samsung.com",),
    "lg": ("lg.com",),
    "sony": ("sony.com",),
    "philips": ("philips.com",),
    "bosch": ("bosch-home.com", "bosch.com"),
    "siemens": ("siemens-home.bsh-group.com",),
    "karcher": ("kaercher.com", "karcher.com"),
    "tefal": ("tefal.com",),
    "braun": ("braun.com",),
    "ariston": ("ariston.com",),
    "beko": ("beko.com",),
    "brother": ("brother.com", "support.brother.com"),
    "hp": ("hp.com",),
    "canon": ("canon.com",),
    "epson": ("epson.com",),
    "dell": ("dell.com",),
    "lenovo": ("lenovo.com",),
    "acer": ("acer.com",),
    "apple": ("apple.com",),
    "xiaomi": ("mi.com",),
    "oppo": ("oppo.com",),
    "oneplus": ("oneplus.com",),
    "google": ("store.google.com",),
    "motorola": ("motorola.com",),
    "nokia": ("nokia.com",),
    "huawei": ("huawei.com", "consumer.huawei.com"),
    "honor": ("honor.com",),
    "intel": ("intel.com",),
    "amd": ("amd.com",),
    "nvidia": ("nvidia.com",),
    "kingston": ("kingston.com",),
    "logitech": ("logitech.com",),
    "2e": ("2e.ua",),
}
CYRILLIC_BRANDS = {"філіпс": "philips", "филипс": "philips", "бош": "bosch", "самсунг": "samsung", "керхер": "karcher", "кархер": "karcher", "тефаль": "tefal", "браун": "braun", "аристон": "ariston", "беко": "beko"}

#: Names of the same characteristic in English, Ukrainian and Russian.
SYNONYMS = (
    "refresh rate; update frequency; частота оновлення; частота обновления; screen refresh rate",
    "response time; reaction time; час відгуку; время отклика",
    "panel type; type of matrix; matrix type; тип матриці; тип матрицы",
    "curvature; curved screen; вигнутий екран; изогнутый экран",
    "power; power consumption; потужність; мощность; rated power",
    "weight; mass; вага; вес; маса; масса",
    "color; colour; колір; цвет",
    "width; ширина", "height; висота; высота", "depth; глибина; глубина",
    "brightness; яскравість; яркость; luminance",
    "contrast; contrast ratio; контрастність; контрастность",
    "diagonal; screen size; display size; діагональ; диагональ",
    "resolution; роздільна здатність; разрешение; display resolution",
    "viewing angle; viewing angles; кут огляду; угол обзора",
    "memory slots; ram slots; memory; dimm slots; слоти пам'яті; слоты памяти; кількість слотів",
    "maximum memory; memory capacity; memory; max memory; максимальна пам'ять; максимальный объем памяти",
    "form factor; форм-фактор; formfactor",
    "spin speed; швидкість віджиму; скорость отжима",
    "noise level; рівень шуму; уровень шума; noise",
    "load capacity; capacity; завантаження; загрузка; максимальне завантаження",
    "battery capacity; ємність акумулятора; емкость аккумулятора; battery",
    "print speed; швидкість друку; скорость печати",
    "pressure; working pressure; тиск; давление; max pressure",
    "material; матеріал; материал", "warranty; гарантія; гарантия",
    "country of origin; made in; країна виробник; страна производитель",
    "energy class; energy efficiency class; клас енергоспоживання; класс энергопотребления",
)
WEAK_WORDS = "type max maximum min number of the for тип макс максимальна максимальный кількість количество".split()

METHOD_WEIGHT = {"infobox": 1.0, "css_selector": 1.0, "jsonld": 0.9, "llm": 0.7}
SINGLE_SOURCE = {"infobox": 1.0, "css_selector": 1.0, "jsonld": 0.95, "llm": 0.85}


def domains(spark: SparkSession) -> DataFrame:
    rows = [(d, p, 0) for d, p in QUALITY.items()] + [(d, p, 1) for d, p in JUNK.items()]
    return spark.createDataFrame(rows, "domain string, points double, kind int")


def brands(spark: SparkSession) -> DataFrame:
    rows = [(b, k, d) for b, ds in BRANDS.items() for k, d in enumerate(ds)]
    return spark.createDataFrame(rows, "brand string, pos int, domain string")


def synonyms(spark: SparkSession) -> DataFrame:
    """(phrase, grp, words): a phrase may be in several groups."""
    rows = [(p.strip(), g) for g, line in enumerate(SYNONYMS) for p in line.split(";")]
    df = spark.createDataFrame(rows, "phrase string, grp int")
    from specloom.functions.text import lower_words_only

    return df.select(lower_words_only(F.col("phrase")).alias("phrase"), "grp").distinct().withColumn("words", F.array_distinct(F.split("phrase", " ")))
