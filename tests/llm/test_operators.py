"""Each operator against a brute-force version, and its edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from specloom.llm import attention_quality, common, decontamination, line_dedup, mixing, near_dup, quality_rules, secret_scan, suffix_dedup, token_counts, token_shards
from specloom.llm.column_bwt import build, rows_of
from specloom.llm.wavelet import WaveletMatrix

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, kept string, d long, h long, key string, root long"


def frame(spark, rows):
    """documents with extra columns whose names the operators use themselves."""
    full = [(i, t, lang, src, len(t or ""), "x", None, 5, 6, "k", 7) for i, t, lang, src in rows]
    return spark.createDataFrame(full, SCHEMA)


def sentence(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(i, sentence(rng, rng.randint(1, 120)), rng.choice(["en", "de", None]), rng.choice(["a", "b", None])) for i in range(60)]
    base = sentence(rng, 90)
    out += [(100 + i, base, "en", "a") for i in range(6)]
    for i in range(6):
        w = base.split()
        w[rng.randrange(len(w))] = "changed"
        out.append((110 + i, " ".join(w), "en", "a"))
    line = "A shared line of enough characters\t"
    out += [(120 + i, f"{sentence(rng, 5)}\n{line}\nshort\n {line.upper()} \n", "de", "b") for i in range(4)]
    out += [(130, None, None, None), (131, "", "en", None), (132, " \t\n ", "en", "a"), (133, "one", "en", "a"), (134, "é" * 5000, "fr", "a")]
    out += [(135, "word " * 3000, "en", "a"), (136, "same row", "en", "a"), (136, "same row", "en", "a"), (None, "no id here", "en", "a")]
    return out


def got(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def base_stats(text):
    text = text or ""
    w = WORDS.findall(text)
    c, covered = Counter(zip(w, w[1:], w[2:], strict=False)), set()
    for i, g in enumerate(zip(w, w[1:], w[2:], strict=False)):
        if c[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_op1_base(spark, rows):
    cols = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got(quality_rules.quality_rules(frame(spark, rows)), *cols) == sorted(((i, *base_stats(t)) for i, t, _, _ in rows), key=str)


def test_op1_outliers_go_and_the_rest_stays(spark):
    rng = random.Random(1)
    docs = [(i, sentence(rng, rng.randint(60, 200)), "en", rng.choice(["a", None])) for i in range(200)]
    docs += [(1000 + i, " ".join(f"{w}***" for w in sentence(rng, 100).split()), "en", "a") for i in range(12)]
    out = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, docs)).collect()}
    assert not any(out[1000 + i].kept or out[1000 + i].base_failed for i in range(12))
    assert all(out[i].kept for i in range(200))


def plain_distances(v):
    """d2 of each row of v from the robust centre of all, by the same starts and steps on plain arrays."""
    floors, p = np.square(quality_rules.FLOORS), v.shape[1]
    low_median = lambda x: np.sort(x)[int(np.ceil(len(x) * 0.5)) - 1]
    med = np.array([low_median(v[:, i]) for i in range(p)])
    scale = np.sqrt((1.4826 * np.array([low_median(abs(v[:, i] - med[i])) for i in range(p)])) ** 2 + floors)
    u = (v - med) / scale
    sign = p * (u / ((u**2).sum(1) + 1e-12)[:, None]).T @ u / len(v) * np.outer(scale, scale) + np.diag(floors)

    def distances(est):
        return ((v - est[0]) @ np.linalg.inv(est[1]) * (v - est[0])).sum(1)

    def support(d):
        bins = np.floor(np.log(d + 1e-9) * quality_rules.BINS)
        edge, h = np.sort(bins)[int(np.ceil(quality_rules.SUPPORT * len(v))) - 1], np.ceil(quality_rules.SUPPORT * len(v))
        return edge, np.where(bins < edge, 1.0, np.where(bins == edge, (h - (bins < edge).sum()) / (bins == edge).sum(), 0.0))

    def step(est):
        w = support(distances(est))[1]
        m = np.average(v, axis=0, weights=w)
        return m, np.cov(v.T, aweights=w, bias=True) + np.diag(floors)

    det = lambda est: np.linalg.slogdet(est[1])[1] / 2
    ends = []
    for est in ((med, np.diag(scale**2)), (med, sign)):
        for _ in range(quality_rules.FIRST_STEPS):
            est = step(est)
        ends.append(est)
    est = min(ends, key=det)
    for _ in range(quality_rules.MOST_STEPS - quality_rules.FIRST_STEPS):
        last, est = est, step(est)
        if abs(det(est) - det(last)) <= quality_rules.STAYS:
            break
    d = distances(est)
    return d / max(1.0, np.exp((support(d)[0] + 1) / quality_rules.BINS) / quality_rules.CHI2_SUPPORT)


def test_op1_distances_match_plain_arrays(spark):
    rng = random.Random(2)
    docs = [(i, sentence(rng, rng.randint(60, 300)) + rng.choice(["", " # $", "\nline\nline"]) * rng.randint(0, 9), rng.choice(["en", None]), rng.choice(["a", "b"])) for i in range(400)]
    docs += [(1000 + i, " ".join(f"{w}***" for w in sentence(rng, 100).split()), "en", "a") for i in range(9)]
    df = frame(spark, docs)
    x = {r.doc_id: r for r in quality_rules._features(quality_rules.base_stats(df)).collect() if not r.base_failed}
    out = {r.doc_id: r for r in quality_rules.quality_rules(df).collect()}
    groups = defaultdict(list)
    for r in x.values():
        groups[r.lang, r.source].append(r)
    for rows in groups.values():
        d2 = plain_distances(np.array([[r[s] for s in quality_rules.STATS] for r in rows]))
        assert np.allclose(d2, [out[r.doc_id].d2 for r in rows], rtol=2e-3, atol=1e-3)
        assert [out[r.doc_id].kept for r in rows] == [bool(d <= quality_rules.CUTOFF) for d in d2]
    assert len(groups) == 4 and sum(not out[1000 + i].kept for i in range(9)) == 9


def expected_targets(sizes, most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {**{s: most * sizes[s] for s in capped}, **share}
        capped |= over


def test_op2(spark, rows):
    out = mixing.mix(frame(spark, rows), shard_words=500).collect()
    again = mixing.mix(frame(spark, rows[::-1]).repartition(5), shard_words=500).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len(WORDS.findall(t or ""))
    want = expected_targets(size)
    by_target = defaultdict(int)
    for r in out:
        assert r.taken <= 3 * r["size"]
        by_target[(r.source_size, round(r.target, 6))] += r.taken
    for s, t in want.items():
        assert abs(by_target[(size[s], round(t, 6))] - t) <= 4 * mixing.BLOCK_WORDS
    assert len(out) == len(rows)


def test_op2_takes_what_the_shards_stream_gives(spark, rows):
    """taken, document by document, from the endless repetition of each shard's documents in their order."""
    docs = [*rows, *rows[:5], *((None, t, "en", "a") for t in ("", "w", "w", None))]
    df = frame(spark, docs)
    out = map(tuple, mixing.mix(df, shard_words=1 << 40, shard_rows=1 << 40).collect())
    order = {}
    for r in df.select("doc_id", "text", "source", F.xxhash64(F.lit(8), "doc_id", common.n_words(F.col("text")), F.xxhash64("text")).alias("o")).collect():
        order.setdefault(r.source, []).append((r.o, -1 if r.doc_id is None else r.doc_id, len(WORDS.findall(r.text or "")), r.doc_id))
    sizes = {s: sum(x[2] for x in v) for s, v in order.items()}
    target = expected_targets(sizes)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    seats, quota = round(sum(target.values()) / mixing.BLOCK_WORDS), dict.fromkeys(names, 0)
    for _ in range(seats):
        free = [s for s in names if quota[s] < 3 * sizes[s] // mixing.BLOCK_WORDS]
        quota[max(free, key=lambda s: (target[s] / (2 * quota[s] + 1), -names.index(s)))] += 1
    want = []
    for s, docs_of in order.items():
        left, took = quota[s] * mixing.BLOCK_WORDS, [0] * len(docs_of)
        stream = sorted(range(len(docs_of)), key=lambda i: docs_of[i][:3])
        while left > 0 and sizes[s]:
            for i in stream:
                n = min(left, docs_of[i][2])
                took[i], left = took[i] + n, left - n
        want += [(docs_of[i][3], docs_of[i][2], sizes[s], round(target[s], 6), took[i]) for i in range(len(docs_of))]
    assert sorted(((a, b, c, round(d, 6), e) for a, b, c, d, e in out), key=str) == sorted(want, key=str)


def test_op2_apportion_is_highest_quotients(spark):
    votes = [("x", i, float(v)) for i, v in enumerate([530, 240, 90, 90, 7, 0])]
    df = spark.createDataFrame(votes, "g string, i int, v double").withColumns({"cap": F.lit(1000), "seats": F.lit(31)})
    quota = {r.i: r.quota for r in mixing.apportion(df, ["g"], F.col("i"), "seats").collect()}
    q = dict.fromkeys(range(6), 0)
    for _ in range(31):
        best = max(range(6), key=lambda i: (votes[i][2] / (2 * q[i] + 1), -i))
        q[best] += 1
    assert quota == q


def covered(texts, window):
    data = [(t or "").encode() for t in texts]
    count = Counter(x[i : i + window] for x in data for i in range(len(x) - window + 1))
    for x in data:
        m = np.zeros(len(x), bool)
        for i in range(len(x) - window + 1):
            if count[x[i : i + window]] > 1:
                m[i : i + window] = True
        yield len(x), int(m.sum()), len(common.runs(m)[0]), hashlib.sha256(np.frombuffer(x, np.uint8)[~m].tobytes()).hexdigest()


@pytest.mark.parametrize("group_strings", [16384, 1])
def test_op3(spark, rows, group_strings, monkeypatch):
    rng = random.Random(5)
    base = sentence(rng, 200)
    more = [(200 + i, "q" * rng.randint(0, 60) + base[a : a + rng.randint(150, 400)] + "z" * 40, None, None) for i in range(25) for a in [rng.randint(0, 600)]]
    docs = [*rows, *more, (300, "ab" * 300, "", ""), (301, "ab" * 101, "", ""), (302, "x" * 199, "", "")]
    real = suffix_dedup.removals
    monkeypatch.setattr(suffix_dedup, "removals", lambda r, w: real(r, w, group_strings=group_strings))
    want = [(i, *x) for (i, *_), x in zip(docs, covered([t for _, t, _, _ in docs], 200), strict=True)]
    assert got(suffix_dedup.suffix_dedup(frame(spark, docs)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=str)


def test_op3_repeated_periodic_rows():
    assert [list(x) for x in suffix_dedup.starts_repeated([b"ab" * 150], np.array([2]), [1], 200)] == [[True] * 101]
    assert suffix_dedup.starts_repeated([], np.zeros(0, np.int64), [], 200) == []


def test_op3_repeated_rows_and_null_ids(spark):
    rng = random.Random(15)
    base = sentence(rng, 120)
    unlike = [sentence(rng, 60) + base[:250] + str(i) for i in range(300)]
    docs = [(7, "ab" * 150, "", "")] * 2 + [(8, base, "", "")] * 1000 + [(None, x, "", "") for x in unlike] + [(-(1 << 63), base[10:] + "!", "", "")]
    want = [(i, *x) for (i, *_), x in zip(docs, covered([t for _, t, _, _ in docs], 200), strict=True)]
    df = frame(spark, docs)
    assert got(suffix_dedup.suffix_dedup(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=str)
    key = F.xxhash64("text").alias("t"), (F.length("text") * 0).cast("long").alias("v"), "text"
    spans = [suffix_dedup.removals(frame(spark, [(8, base, "", "")] * n + [(9, base + "?", "", "")]).select(*key)).count() for n in (2, 40)]
    assert spans[0] == spans[1]


def test_column_bwt():
    rng = random.Random(3)
    for t in range(60):
        s = [bytes(rng.choice(b"ab" if t % 2 else b"abcd") for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 9))]
        b, lcp = build(s)
        suffixes = sorted((tuple(y + 1000 for y in x[k:]) + (i,), i, k) for i, x in enumerate(s) for k in range(len(x) + 1))
        assert list(b) == [s[i][k - 1] + 1 if k else 0 for _, i, k in suffixes]
        common_prefix = [0] + [next((n for n, (x, y) in enumerate(zip(a[0], z[0], strict=False)) if x != y), min(len(a[0]), len(z[0]))) for a, z in zip(suffixes, suffixes[1:], strict=False)]
        assert list(lcp) == common_prefix
        found = rows_of(s, b)
        assert all(found[i][k] == r for r, (_, i, k) in enumerate(suffixes) if k < len(s[i]))


def test_op4(spark):
    rng = random.Random(6)
    items = [(k, sentence(rng, rng.randint(15, 150), "abcdefghij")) for k in range(12)] + [(90, None), (91, "not there")]
    docs, leaks = [], set()
    for i in range(60):
        text = sentence(rng, 150, "klmnopqrst")
        if i % 3 == 0:
            k, item = items[i // 3 % 12]
            w = [x if rng.random() > 0.12 else "edited" for x in item.split()]
            text, leaks = f"{text}, {' '.join(w).title()}. {text}", leaks | {(i, k)}
        docs.append((i, text, "en", "a"))
    docs += [(500, None, None, None), (501, "", "", "")]
    out = decontamination.decontamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit(1)))
    assert {(r.doc_id, r.item_id) for r in out.collect()} == leaks


def test_op4_short_items_and_both_joins(spark):
    items = [(1, "alpha beta"), (2, "one two three four five"), (3, "gamma"), (4, None), (5, "... !"), (6, " ".join(f"w{i}" for i in range(20)))]
    texts = ["x Alpha, beta y", "alpha x beta", "one two three four five six", "one two three four x five", "a gamma", "gammas", "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 x y z"]
    want = {(0, 1), (2, 2), (4, 3), (6, 6)}
    for most in (100, 0):
        out = decontamination.decontamination(frame(spark, [(i, t, "", "") for i, t in enumerate(texts)]), spark.createDataFrame(items, "item_id long, text string"), broadcast_seeds=most)
        assert {(r.doc_id, r.item_id) for r in out.collect()} == want


def plain_score(item, text):
    """Best local alignment of tokens over that of an exact copy, cell by cell."""
    a, b = (re.findall(r"[0-9a-z]+|[^\x00-\x7f]+", x.lower()) for x in (item, text))
    last, best = [0] * (len(b) + 1), 0
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(max(0, last[j] + (2 if x == y else -1), last[j + 1] - 1, now[j] - 1))
        last, best = now, max(best, *now)
    return best / (2 * len(a)) if a else 0


def test_op4_against_all_alignments(spark):
    """Every pair that aligns and shares three tokens in a row is found with its score, and no other."""
    rng = random.Random(22)
    items = [(k, sentence(rng, rng.randint(9, 60), "abcd")) for k in range(8)]
    docs = []
    for i in range(50):
        w = items[i % 8][1].split()
        w = [rng.choice(["new", x + "x"]) if rng.random() < i / 70 else x for x in w if rng.random() > i / 300]
        docs.append((i, f"{sentence(rng, 40, 'klmn')} {' '.join(w)} {sentence(rng, 40, 'klmn')}", "", ""))
    grams = lambda t: set(zip(t.split(), t.split()[1:], t.split()[2:], strict=False))
    want = {(i, k): plain_score(x, t) for i, t, _, _ in docs for k, x in items if plain_score(x, t) >= 0.5 and grams(x) & grams(t)}
    out = decontamination.decontamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id): r.score for r in out}
    assert found.keys() == want.keys() and len(want) >= 20
    assert all(abs(found[k] - v) < 1e-6 for k, v in want.items())


def test_op4_edited_copy_beside_a_verbatim_one(spark):
    rng = random.Random(12)
    items = [(k, sentence(rng, n, "abcdefghij")) for k, n in enumerate((16, 30, 59))]
    docs, leaks = [(i, sentence(rng, 150, "klmnopqrst"), "en", "a") for i in range(20)], set()
    for k, item in items:
        edited = " ".join("edited" if j % 4 == 3 else x for j, x in enumerate(item.split()))
        docs += [(100 + k, f"{docs[0][1]} {item} {docs[1][1]}", "en", "a"), (200 + k, f"{docs[2][1]} {edited} {docs[3][1]}", "en", "a")]
        leaks |= {(100 + k, k), (200 + k, k)}
    out = decontamination.decontamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in out} == leaks
    assert all(r.score == 1 if r.doc_id < 200 else 0.5 <= r.score < 0.7 for r in out)


def test_alignment_against_plain_matrix():
    rng = random.Random(7)
    for _ in range(40):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in range(2))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if x == y else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontamination.align(np.array([a]), np.array([b]))[0][0] == h.max()


def shingles(text, k):
    w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("k", [2, 5])
def test_op5(spark, rows, k):
    rng = random.Random(8)
    chain, docs = sentence(rng, 60).split(), list(rows)
    for i in range(12):  # each is like the one before, the first and the last are not alike
        chain = [x if rng.random() > 0.03 else f"new{i}" for x in chain]
        docs.append((400 + i, " ".join(chain), "en", "a"))
    sets = {}
    for i, t, _, _ in docs:
        if i is not None:
            sets[i] = shingles(t, k)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= 80 * (len(sets[x]) + len(sets[y]) - both):
                    a, b = sorted((find(x), find(y)))
                    root[b] = a
    want = [(i, len(shingles(t, k)), None if i is None else find(i), i is None or find(i) == i) for i, t, _, _ in docs]
    assert got(near_dup.near_dup(frame(spark, docs), k=k), "doc_id", "n_shingles", "component_id", "kept") == sorted(want, key=str)


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(1, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)]
    seen = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for a in seen:
        reach, todo = {a}, [a]
        while todo:
            new = near[todo.pop()] - reach
            reach |= new
            todo += new
        assert seen[a] == min(reach)


def test_op6(spark, rows):
    rng = random.Random(10)
    docs = [(1000 + i, sentence(rng, 80) if i % 2 else " ".join(f"{w}$$" for w in sentence(rng, 80).split()), "en", "a") for i in range(200)]
    labels = spark.createDataFrame([(1000 + i, i % 2, 0) for i in range(200)] + [(1001, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = attention_quality.attention_quality(frame(spark, docs + rows), labels).collect()
    assert len(out) == len(docs) + len(rows)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0)
        if r.held_out and r.doc_id is not None and r.doc_id >= 1000:
            assert r.predicted == r.doc_id % 2
    none = attention_quality.attention_quality(frame(spark, rows[:3]), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def plain_passages(text):
    """The features of each passage of a text, byte by byte and word by word."""
    data = text.encode()
    words = [(m.start(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    for a in range(0, max(1, len(data)), attention_quality.PASSAGE):
        part = data[a : a + attention_quality.PASSAGE]
        own = [w for at, w in words if a <= at < a + attention_quality.PASSAGE]
        kinds = Counter(int(attention_quality._CLASS[b]) for b in part)
        size, n = max(1, len(part)), max(1, len(own))
        x = [(kinds[k] / size) ** 0.5 for k in range(attention_quality.CLASSES)]
        x += [len(set(own)) / n if own else 1, sum(map(len, own)) / n / 10, sum(65 <= w[0] <= 90 for w in own) / n]
        yield [*x, np.log1p(len(own)), np.log1p(len(part)), (part.count(10) / size) ** 0.5]


def test_op6_scores_match_plain_ones(spark, rows):
    rng = random.Random(23)
    docs = [(1000 + i, f"{sentence(rng, 80 + 9 * (i % 7))}\n" if i % 2 else " ".join(f"{w.title()}$$" for w in sentence(rng, 80).split()), "en", "a") for i in range(120)]
    labels = spark.createDataFrame([(1000 + i, i % 2) for i in range(120)], "doc_id long, quality int")
    df = frame(spark, docs + rows + rows[:3])
    model = attention_quality.fit(df, labels)
    w = model.weights
    out = defaultdict(set)
    for r in attention_quality.attention_quality(df, labels).collect():
        out[r.doc_id].add(r.score)
    for i, t, _, _ in docs + rows:
        h = [np.tanh(np.clip((np.array(x) - model.mean) / model.scale, -8, 8) @ w["w1"] + w["b1"]) for x in plain_passages(t or "")]
        e = np.array([(np.tanh(v @ w["v"]) / (1 + np.exp(-(v @ w["u"])))) @ w["a"] for v in h])
        a = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        p = 1 / (1 + np.exp(-(sum(k * v for k, v in zip(a, h, strict=True)) @ w["c"] + w["b"][0])))
        assert any(abs(p - x) < 1e-4 for x in out[i]) and all(0 <= x <= 1 for x in out[i])


def test_op6_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = attention_quality.op6_attention_quality(spark, sf).where("held_out").join(labels.select("doc_id", "quality"), "doc_id").collect()
    good, bad = [r.score for r in out if r.quality == 1], [r.score for r in out if r.quality == 0]
    assert len(good) > 20 and len(bad) > 5
    assert np.mean([[(g > b) + (g == b) / 2 for b in bad] for g in good]) > 0.97
    assert np.mean([r.predicted == r.quality for r in out]) > 0.95


def test_op6_learns_from_late_passages(spark):
    rng = random.Random(13)
    plain = sentence(rng, 6000)
    docs = []
    for i in range(60):
        late = sentence(rng, 800).split()
        docs.append((i, f"{plain} {' '.join(late if i % 2 else [f'{w}$$' for w in late])}", "en", "a"))
    assert len(plain) > 64 * attention_quality.PASSAGE
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    held = [r for r in attention_quality.attention_quality(frame(spark, docs), labels).collect() if r.held_out]
    assert {r.doc_id % 2 for r in held} == {0, 1}
    assert all(r.predicted == r.doc_id % 2 for r in held)


def test_op6_gradient():
    rng = np.random.default_rng(0)
    x, per = rng.normal(size=(9, attention_quality.FEATURES)), np.array([2, 3, 4])
    a = attention_quality.train(x, per, np.array([0.0, 1.0, 1.0]), np.ones(3), steps=120)
    assert np.abs(a.score(x, per) - [0, 1, 1]).max() < 0.1


def test_op7(spark, rows, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_shards.default_tokenizer())
    docs = [*rows, (800, "İSTANBUL ǅ don't it's 12.5 <|ENDOFTEXT|> <|endoftext|> ä ̈x ﬁ", "", ""), (801, "x y z ＡＢＣ ١٢", "", "")]
    path = str(tmp_path / "shards")
    token_shards.write_shards(frame(spark, docs), path)
    out = sorted(token_shards.read_index(spark, path).collect(), key=lambda r: r.start)
    want = sorted(((i if i is not None else -1, t.encode(x or "", add_special_tokens=False).ids + [1]) for i, x, _, _ in docs), key=lambda r: r[0])
    at, every = 0, []
    for r, (i, ids) in zip(out, want, strict=True):
        assert (r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
        every += ids
    token = Counter(every).most_common(3)[2][0]
    assert sum(r.n for r in token_shards.count_token(spark, path, token).collect()) == every.count(token)
    assert token_shards.find_token(spark, path, token).count() == every.count(token)


def test_op7_rows_of_one_id_keep_one_order(spark):
    docs = [(5, f"text {k}", "", "") for k in range(30)] + [(None, f"none {k}", "", "") for k in range(30)] + [(5, "text 3", "", "")]
    runs = [sorted(map(tuple, token_shards.token_shards(frame(spark, d).repartition(n)).collect()), key=lambda r: r[1]) for d, n in ((docs, 3), (docs[::-1], 7))]
    assert runs[0] == runs[1]
    assert all(a[1] + a[2] == b[1] for a, b in zip(runs[0], runs[0][1:], strict=False))


def test_op7_words_past_the_memory(spark, monkeypatch):
    rng = random.Random(24)
    texts = [sentence(rng, 60) + " é… ½x 1,234 don't" for _ in range(40)]
    encoder = token_shards.WordEncoder(token_shards.default_tokenizer())
    monkeypatch.setattr(token_shards, "CACHED_BYTES", 500)
    for k in range(0, 40, 8):
        ids, lengths = encoder.encode(pa.array(texts[k : k + 8]), None)
        want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts[k : k + 8]]
        assert ids.tolist() == [i for w in want for i in w] and lengths.tolist() == list(map(len, want))
    encoder.keys[:] = encoder.keys[0]  # words whose hashes agree are told apart by their bytes
    ids, _ = encoder.encode(pa.array(texts[:3]), None)
    assert ids.tolist() == [i for t in texts[:3] for i in encoder.tokenizer.encode(t, add_special_tokens=False).ids]


def test_hash_spans_of_any_length():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 3 * common.HASH_PIECE).astype(np.uint8)
    data[-900:] = data[100:1000]
    starts = np.sort(np.concatenate([rng.integers(0, len(data) - 50, 500), [100, len(data) - 900]]))
    ends = starts + rng.integers(0, 50, len(starts))
    ends[0] = len(data)
    i, j = int(np.flatnonzero(starts == 100)[0]), int(np.flatnonzero(starts == len(data) - 900)[0])
    ends[i], ends[j] = 1000, len(data)
    h = common.hash_spans(data, starts, ends)
    assert h[i] == h[j]
    for k in (0, 1, 7, 499):
        total, power = 0, 1
        for b in data[starts[k] : ends[k]].tolist():
            total, power = (total + (b + 0x9E37) * power) % (1 << 64), power * common._FACTOR % (1 << 64)
        want = common.mix(np.array([(total + int(ends[k] - starts[k]) * int(common._LENGTH)) % (1 << 64)], np.uint64))[0]
        assert h[k] == want


def test_very_long_texts(spark):
    """A text of half a megabyte and a word of as much go through whole: what stands at their ends counts."""
    rng = random.Random(25)
    long, item = sentence(rng, 90_000), sentence(rng, 30, "mnopqrst")
    word = "".join(rng.choice("abcdef") for _ in range(600_000))
    docs = [(1, f"{long} {item}", "en", "a"), (2, long, "en", "a"), (3, word, "en", "a"), (4, word, "en", "a"), (5, word[:-1] + "!", "en", "a"), (6, f"{long}\ntoken=abcdefgh", "en", "a")]
    df = frame(spark, docs)
    leaks = decontamination.decontamination(df, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.score) for r in leaks] == [(1, 1.0)]
    assert {r.doc_id: r.component_id for r in near_dup.near_dup(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 1}
    assert {r.doc_id: r.n_assign for r in secret_scan.secret_scan(df).collect()}[6] == 1
    assert {r.doc_id: r.n_words for r in token_counts.token_counts(df).collect()}[1] == 90_030
    assert {r.doc_id: (r.n_bytes == r.n_removed) for r in suffix_dedup.suffix_dedup(df).collect()} == {1: False, 2: True, 3: True, 4: True, 5: False, 6: False}
    assert {r.doc_id: r.n_words for r in quality_rules.quality_rules(df).collect()}[1] == 90_030
    assert sum(r.taken for r in mixing.mix(df).collect()) > 0
    starts = sorted(map(tuple, token_shards.token_shards(df).select("start", "n_tokens").collect()))
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
    assert all(0 <= r.score <= 1 for r in attention_quality.attention_quality(df, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")).collect())
    assert {r.doc_id: r.n_lines for r in line_dedup.line_dedup(df).collect()}[6] == 2


def test_wavelet():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 513, 3000):
        ids = rng.integers(0, 49408 if n % 2 else 30, n).astype(np.uint16)
        w = WaveletMatrix.from_bytes(WaveletMatrix.build(ids).to_bytes())
        assert (w.decode() == ids).all()
        assert [w.access(i) for i in range(0, n, 11)] == ids[::11].tolist()
        for token in set(ids[:5].tolist()) | {65535}:
            assert w.occurrences(token) == np.flatnonzero(ids == token).tolist()
            assert w.rank(token, n // 2) == int((ids[: n // 2] == token).sum())
    with pytest.raises(IndexError):
        w.access(3000)


def test_op8(spark, rows):
    rng = random.Random(11)
    secret = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(40))
    texts = [
        f"é PassWord = 'abcdef12' and token=token:abcdefgh AKIA{'A1' * 8} AKIAZ",
        "deadbeef" * 3 + " " + "0" * 23 + " api_key : \"short\" apikey=longenough",
        f"key {secret} here",
        "uuid 123e4567-e89b-12d3-a456-426614174000 long_identifier_name_2024_version12 2024-01-01/2024-12-31/2025",
        "D41D8CD98F00B204E9800998ECF8427E ſecret=abcdefgh",
    ]
    docs = [*rows, *((900 + i, x, "", "") for i, x in enumerate(texts))]
    out = {r.doc_id: r for r in secret_scan.secret_scan(frame(spark, docs)).collect()}
    assert len(out) <= len(docs)
    pattern = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, t, _, _ in docs:
        t = t or ""
        base = [("assign", m.start(), m.end()) for m in pattern.finditer(t) if len(m[2]) >= 6]
        base += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        base += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        base.sort(key=lambda x: (x[1], ["assign", "access", "hex"].index(x[0])))
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert out[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(out[i].spans.split(","))
    assert out[902].spans == "random:4:44"
    assert out[903].spans == out[904].spans == ""


def test_op8_random_letters_without_a_digit(spark):
    rng = random.Random(14)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    texts = [f"key {''.join(rng.choice(letters) for _ in range(n))} here" for n in (20, 24, 32, 40) for _ in range(5)]
    names = ["getAttributeServiceFactoryInstance", "a_long_identifier_name_of_words", "Some/Path/To/A/Source/File", "MAXIMUM_NUMBER_OF_RETRIES", "internationalization"]
    docs = [(i, x, "", "") for i, x in enumerate(texts + [f"key {x} here" for x in names])]
    out = {r.doc_id: r.spans for r in secret_scan.secret_scan(frame(spark, docs)).collect()}
    assert [out[i] for i in range(len(texts))] == [f"random:4:{len(x) - 5}" for x in texts]
    assert not any(out[i] for i in range(len(texts), len(docs)))


def test_op8_takes_linear_time():
    enc = secret_scan.encoding(secret_scan.default_vocabulary())
    began = time.time()
    assert not secret_scan.known("-" * 100_000 + "a1b2ccccc9x")
    assert secret_scan.known("-" * 100_000 + "ab_12")
    for text in ("-" * 100_000 + "a1b2ccccc9x", "aB" * 50_000, "token" + " " * 100_000, "0f" * 12 + " " + ("0f" * 12 + " ") * 4000):
        base = secret_scan.base_spans(text)
        secret_scan.random_spans(text, base, enc)
    assert time.time() - began < 2


def test_op8_identifiers():
    """The parts one by one are what one pattern with repeats says, on strings short enough for it."""
    rng = random.Random(21)
    whole = re.compile(r"[0-9_/+-]+|([A-Za-z]?[a-z]*|[A-Z]*|[0-9]{1,4})([_/+-]([A-Za-z]?[a-z]*|[A-Z]*|[0-9]{1,4}))*")
    for _ in range(3000):
        s = "".join(rng.choice("aB1-_") for _ in range(rng.randint(0, 9)))
        assert secret_scan.known(s) == (whole.fullmatch(s) is not None)


def test_op9(spark, rows):
    scores = token_counts.unigram_scores(token_counts.default_vocabulary())
    longest = max(map(len, scores))

    @cache
    def best(word):
        s, n = [0.0], [0]
        for end in range(1, len(word) + 1):
            options = [(s[end - 1] + token_counts.UNKNOWN, -(n[end - 1] + 1))]
            options += [(scores[word[a:end]] + s[a], -(n[a] + 1)) for a in range(max(0, end - longest), end) if word[a:end] in scores]
            top = max(options)
            s.append(top[0])
            n.append(-top[1])
        return n[-1]

    want = []
    for i, t, _, _ in rows:
        w = WORDS.findall(t or "")
        want.append((i, len(w), sum(best(token_counts.SPACE + x) for x in w)))
    out = got(token_counts.token_counts(frame(spark, rows)), "doc_id", "n_words", "n_tokens")
    assert out == sorted(want, key=str)
    trie = token_counts.TrieCounter(scores)
    trie.counts(["abcdef", "abcxyz", "abc"])
    assert trie.nodes == 9


def test_op10(spark, rows):
    def key(x):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))

    held = defaultdict(set)
    for i, t, _, _ in rows:
        for x in (t or "").split("\n"):
            held[key(x)].add(-1 if i is None else i)
    want = []
    for i, t, _, _ in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(key(x)) < 20 or len(held[key(x)]) < 3 or max(held[key(x)]) == (-1 if i is None else i)]
        want.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    assert got(line_dedup.line_dedup(frame(spark, rows)), "doc_id", "n_lines", "n_dropped", "kept_text") == sorted(want, key=str)


def test_empty_tables(spark):
    docs = frame(spark, [(1, "x", "en", "a")]).limit(0)
    items, labels = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for df in (
        quality_rules.quality_rules(docs),
        mixing.mix(docs),
        suffix_dedup.suffix_dedup(docs),
        decontamination.decontamination(docs, items),
        near_dup.near_dup(docs),
        attention_quality.attention_quality(docs, labels),
        token_shards.token_shards(docs),
        secret_scan.secret_scan(docs),
        token_counts.token_counts(docs),
        line_dedup.line_dedup(docs),
    ):
        assert df.count() == 0
