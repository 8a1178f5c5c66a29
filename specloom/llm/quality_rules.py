"""Quality rules with robust multivariate outliers: minimum covariance determinant per language and source.

Native: DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specloom.llm.common import SPACE_CHARS, cut, documents, mark

SYMBOLS = "#*$%&|<>"
#: Statistics of a document, each transformed so that ordinary text is about symmetric.
STATS = ("log_words", "word_len", "symbols", "dup_lines", "repeats")
#: Standard deviations added in quadrature to each statistic, so that one which is constant in a group
#: (no symbols at all, say) still has a scale: 1 in log words, 0.5 characters, 0.1 in the root of symbols a word, 0.15 in other roots.
FLOORS = (1.0, 0.5, 0.1, 0.15, 0.15)
#: Share of a group that the estimate rests on, and the squared distance from which a document is an outlier:
#: the quantile of chi squared with 5 degrees of freedom that 1 in 10**7 ordinary documents exceed.
SUPPORT, CUTOFF = 0.75, 40.9
#: SUPPORT quantile of chi squared with 5 degrees of freedom.
CHI2_SUPPORT = 6.626
#: Bins of the logarithm of a squared distance.
BINS = 64
#: Concentration steps from each start; then at most so many in all, until no log determinant moves by STAYS.
FIRST_STEPS, MOST_STEPS, STAYS = 2, 12, 1e-5


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def base_stats(docs: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words) per row of docs, and the columns of also.

    Repeated 3-word windows are found inside the row by hash: none or few distinct repeats by membership,
    more by sorting (hash, position) pairs, so the cost stays n log n however repetitive a text is.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", "lang", "source", *also, text.alias("text"))
    d = d.select("*", F.btrim("text", F.lit(SPACE_CHARS)).alias("body"))
    d = d.select(
        "doc_id",
        "lang",
        "source",
        *also,
        F.when(F.col("body") == "", F.array().cast("array<string>")).otherwise(F.split("body", r"[\x20\x09-\x0D]+")).alias("w"),
        F.length(F.translate("body", SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "").alias("lines"),
    )
    head = ["doc_id", "lang", "source", *also, "word_chars", "n_symbols"]
    d = d.select(*head, F.size("w").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))).alias("h"))
    head += ["n_words", "n_lines", "n_dup_lines"]
    d = d.select(*head, F.slice("h", F.lit(1), F.greatest(F.lit(0), F.size("h") - 2)).alias("h"))
    d = d.select(*head, "h", F.sort_array("h").alias("s"))
    d = d.select(*head, "h", F.array_distinct(F.filter("s", lambda x, i: (i > 0) & (x == F.get("s", i - 1)))).alias("twice"))
    few = F.filter(F.transform("h", lambda x, i: F.when(F.array_contains("twice", x), i)), lambda i: i.isNotNull())
    pairs = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def equal_to(p: Column, other: Column) -> Column:
        return F.coalesce(p["x"] == other["x"], F.lit(False))

    many = _let(pairs, lambda v: F.sort_array(F.transform(F.filter(v, lambda p, j: F.when(j > 0, equal_to(p, F.get(v, j - 1))).otherwise(False) | equal_to(p, F.get(v, j + 1))), lambda p: p["i"])))
    d = d.select(*head, F.when(F.size("twice") == 0, F.array().cast("array<int>")).when(F.size("twice") <= 48, few).otherwise(many).alias("at"))
    covered = F.aggregate(F.transform("at", lambda a, j: F.least(F.lit(3), F.coalesce(F.get("at", j + 1) - a, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return d.select(*head, covered.cast("long").alias("n_repeat_words"))


def _features(base: DataFrame) -> DataFrame:
    n, failed = F.greatest(F.col("n_words"), F.lit(1)), (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    x = (F.log1p("n_words"), F.col("word_chars") / n, F.sqrt(F.col("n_symbols") / n), F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))), F.sqrt(F.col("n_repeat_words") / n))
    return base.withColumn("base_failed", failed).withColumns({s: F.round(c, 6) for s, c in zip(STATS, x, strict=True)})


def _cholesky(est: DataFrame) -> DataFrame:
    """(lang, source, start, m0.., l00.., log_det) from (lang, source, start, m0.., c00..): the lower factor of each covariance."""
    p = len(STATS)
    for i in range(p):
        for j in range(i + 1):
            s = F.col(f"c{j}{i}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            est = est.withColumn(f"l{i}{j}", F.sqrt(F.greatest(s, F.lit(1e-12))) if i == j else s / F.col(f"l{j}{j}"))
    log_det = sum((F.log(F.col(f"l{i}{i}")) for i in range(p)), F.lit(0.0))
    kept = [F.round(f"m{i}", 9).alias(f"m{i}") for i in range(p)] + [F.round(f"l{i}{j}", 9).alias(f"l{i}{j}") for i in range(p) for j in range(i + 1)]
    return est.select("lang", "source", "start", *kept, F.round(log_det, 9).alias("log_det"))


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.lang").eqNullSafe(F.col(f"{b}.lang")) & F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))


def _distances(x: DataFrame, est: DataFrame) -> DataFrame:
    """x with m0.. and d2, the squared Mahalanobis distance from its group's estimate."""
    p = len(STATS)
    d = x.alias("x").join(est.alias("e"), _same("x", "e")).select("x.*", *[f"e.{c}" for c in est.columns if c not in ("lang", "source")])
    for i in range(p):
        s = F.col(STATS[i]) - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * F.col(f"y{k}") for k in range(i)), F.lit(0.0))
        d = d.withColumn(f"y{i}", s / F.col(f"l{i}{i}"))
    return d.withColumn("d2", sum((F.col(f"y{i}") ** 2 for i in range(p)), F.lit(0.0)))


def _support(d: DataFrame) -> DataFrame:
    """(lang, source, start, edge, share): the bin of d2 in which SUPPORT of the group's documents are reached, and the share of it that is needed.

    Counts per bin are exact and merge map-side, so a group of any size comes to a few hundred rows.
    """
    keys = ["lang", "source", "start"]
    counts = d.groupBy(*keys, _bin().alias("bin")).agg(F.count("*").alias("c"))
    group = Window.partitionBy(*keys)
    counts = counts.withColumns({"h": F.ceil(SUPPORT * F.sum("c").over(group)), "upto": F.sum("c").over(group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))})
    e = counts.where(F.col("upto") >= F.col("h")).groupBy(*keys).agg(F.min(F.struct("bin", "c", "upto", "h")).alias("e"))
    return e.select(*keys, F.col("e.bin").alias("edge"), ((F.col("e.h") - F.col("e.upto") + F.col("e.c")) / F.col("e.c")).alias("share"))


def _bin() -> Column:
    return F.floor(F.log(F.col("d2") + 1e-9) * BINS).cast("long")


def _c_step(x: DataFrame, est: DataFrame) -> DataFrame:
    """Concentrate once: mean and covariance of the SUPPORT share of documents nearest to the last estimate.

    The documents of the edge bin, whose distances differ by 1 in BINS at most, all count with the share that
    makes up the rest, so every subset weighs the same, whatever ties there are, and determinants compare.
    """
    p = len(STATS)
    d = _distances(x, est)
    inner = d.alias("d").join(_support(d).alias("s"), _same("d", "s") & (F.col("d.start") == F.col("s.start"))).where(_bin() <= F.col("s.edge"))
    inner = inner.select("d.*", F.when(_bin() == F.col("s.edge"), F.col("s.share")).otherwise(1.0).alias("w"))
    c = [F.col(STATS[i]) - F.col(f"m{i}") for i in range(p)]
    mean = lambda v: F.sum(F.col("w") * v) / F.sum("w")
    sums = {f"s{i}": mean(c[i]) for i in range(p)} | {f"s{i}{j}": mean(c[i] * c[j]) for i in range(p) for j in range(i, p)} | {f"m{i}": F.first(f"m{i}") for i in range(p)}
    g = inner.groupBy("lang", "source", "start").agg(*[v.alias(k) for k, v in sums.items()])
    cov = {f"c{i}{j}": F.col(f"s{i}{j}") - F.col(f"s{i}") * F.col(f"s{j}") + F.lit(FLOORS[i] ** 2 if i == j else 0.0) for i in range(p) for j in range(i, p)}
    g = g.select("lang", "source", "start", *[(F.col(f"m{i}") + F.col(f"s{i}")).alias(f"m{i}") for i in range(p)], *[v.alias(k) for k, v in cov.items()])
    return mark(_cholesky(g))


def _starts(x: DataFrame) -> DataFrame:
    """Two deterministic starts a group: medians with absolute deviations, and medians with the spatial sign covariance."""
    p = len(STATS)
    med = mark(x.groupBy("lang", "source").agg(*[F.percentile_approx(s, 0.5, 1000).alias(f"m{i}") for i, s in enumerate(STATS)]))
    near = x.alias("x").join(med.alias("e"), _same("x", "e")).select("x.*", *[f"e.m{i}" for i in range(p)])
    mad = mark(near.groupBy("lang", "source").agg(*[F.first(f"m{i}").alias(f"m{i}") for i in range(p)], *[F.percentile_approx(F.abs(F.col(s) - F.col(f"m{i}")), 0.5, 1000).alias(f"a{i}") for i, s in enumerate(STATS)]))
    scale = [F.sqrt((1.4826 * F.col(f"a{i}")) ** 2 + FLOORS[i] ** 2) for i in range(p)]
    means = [f"m{i}" for i in range(p)]
    plain = mad.select("lang", "source", F.lit(0).alias("start"), *means, *[(scale[i] ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in range(p) for j in range(i, p)])
    u = x.alias("x").join(mad.alias("e"), _same("x", "e")).select("x.*", *means, *[s.alias(f"z{i}") for i, s in enumerate(scale)])
    u = u.withColumns({f"u{i}": (F.col(s) - F.col(f"m{i}")) / F.col(f"z{i}") for i, s in enumerate(STATS)})
    u = u.withColumn("r2", sum((F.col(f"u{i}") ** 2 for i in range(p)), F.lit(1e-12)))
    sign = u.groupBy("lang", "source").agg(*[F.first(m).alias(m) for m in means], *[F.first(f"z{i}").alias(f"z{i}") for i in range(p)], *[F.avg(F.col(f"u{i}") * F.col(f"u{j}") / F.col("r2")).alias(f"c{i}{j}") for i in range(p) for j in range(i, p)])
    sign = sign.select("lang", "source", F.lit(1).alias("start"), *means, *[(p * F.col(f"c{i}{j}") * F.col(f"z{i}") * F.col(f"z{j}") + F.lit(FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i in range(p) for j in range(i, p)])
    return mark(_cholesky(plain.unionByName(sign)))


def _best(est: DataFrame) -> DataFrame:
    """The start of least determinant for each language and source."""
    cols = [c for c in est.columns if c not in ("lang", "source")]
    return est.groupBy("lang", "source").agg(F.min_by(F.struct(*cols), F.struct("log_det", "start")).alias("e")).select("lang", "source", "e.*")


def _moved(a: DataFrame, b: DataFrame) -> float:
    """The most that a log determinant differs by."""
    j = a.alias("a").join(b.alias("b"), _same("a", "b") & (F.col("a.start") == F.col("b.start")))
    return j.agg(F.max(F.abs(F.col("a.log_det") - F.col("b.log_det")))).first()[0] or 0.0


def mcd(x: DataFrame, most_steps: int = MOST_STEPS) -> DataFrame:
    """(lang, source, start, m0.., l.., log_det, factor): the estimate of least determinant for each language and source.

    Concentration steps run from both starts at once; after FIRST_STEPS the smaller determinant of each group
    goes on until no determinant moves, most_steps at most. Each covariance is that of the subset plus the
    squares of FLOORS on its diagonal, a regularised determinant, so that statistics that are constant in a
    group neither break it nor make outliers of the first that differ. factor makes distances consistent: the
    SUPPORT quantile of d2 over that of chi squared, never under 1.
    """
    est = _starts(x)
    for step in range(most_steps):
        new = _c_step(x, est)
        if step == FIRST_STEPS - 1:
            new = mark(_best(new))
        still = step >= FIRST_STEPS and _moved(new, est) <= STAYS
        est = new
        if still:
            break
    edge = _support(_distances(x, est))
    factor = F.greatest(F.lit(1.0), F.exp((F.col("s.edge") + 1) / BINS) / CHI2_SUPPORT)
    return mark(est.alias("e").join(edge.alias("s"), _same("e", "s")).select("e.*", factor.alias("factor")))


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Return (doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, d2), one row for each row of docs.

    base_failed: fewer than 50 words, or over half of the words in 3-word windows found twice or more. The
    others are judged by their transformed statistics: kept if the squared Mahalanobis distance from the
    robust centre of their language and source is at most cutoff. The estimates are fitted on all documents
    that pass the base rules; nulls in lang and source make groups of their own; repeated rows count as often
    as they come. Null and empty texts have no words and fail the base rules; d2 is null where base_failed.
    Texts are read once; what the steps read again are 5 numbers a document.
    """
    x = cut(_features(base_stats(docs)), "quality-stats")
    d = _judged(x, _fitted(x), cutoff)
    return d.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")


def kept_rows(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id quality_rules keeps a row of; null ids are one id.

    Texts are read twice, to fit and to judge each where it stands, and never dealt out. Where rows of one id
    are judged differently, those that fail are looked up among such ids.
    """
    x = cut(_features(base_stats(docs)), "quality-stats")
    est = _fitted(x)
    verdicts = _judged(x, est, cutoff).groupBy("doc_id").agg(F.min("kept").alias("lo"), F.max("kept").alias("hi"))
    mixed = cut(verdicts.where("lo != hi").select(F.col("doc_id").alias("id")), "quality-mixed")
    rows = docs.select("doc_id", "lang", "source", "text", F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"))
    told = _features(base_stats(rows, ("row",))).withColumn("at", F.monotonically_increasing_id())
    d = _judged(told, F.broadcast(est), cutoff)  # what is asked of `at` keeps filters above the statistics, which they would repeat many times over
    out = d.where("kept and at >= 0").select("row.*")
    if mixed.isEmpty():
        return out
    return out.unionByName(d.where("not kept and at >= 0").join(mixed, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("row.*"))


def _fitted(x: DataFrame) -> DataFrame:
    return mcd(x.where(~F.col("base_failed")).select("lang", "source", *STATS))


def _judged(x: DataFrame, est: DataFrame, cutoff: float) -> DataFrame:
    """x with d2 and kept, by the estimates of mcd, one row a language and source."""
    p = len(STATS)
    d = x.alias("x").join(est.alias("e"), _same("x", "e"), "left").select("x.*", *[f"e.{c}" for c in est.columns if c not in ("lang", "source")])
    for i in range(p):
        s = F.col(STATS[i]) - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * F.col(f"y{k}") for k in range(i)), F.lit(0.0))
        d = d.withColumn(f"y{i}", s / F.col(f"l{i}{i}"))
    d2 = F.when(~F.col("base_failed"), F.round(sum((F.col(f"y{i}") ** 2 for i in range(p)), F.lit(0.0)) / F.col("factor"), 6))
    return d.select(*x.columns, (~F.col("base_failed") & (d2 <= cutoff)).alias("kept"), d2.alias("d2"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")
