"""Each stage of the pipeline on its own input, and all of them on the smallest tables."""

import random

import corpus_pipeline
import duckdb
import pytest

from specloom.llm import quality_rules
from specloom.llm import queries as llm

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = [(i, " ".join(word() for _ in range(80)), "en", rng.choice("ab"), 5, "x", i) for i in range(80)]
    rows += [(200 + i, rows[i][1], "en", "a", 5, "x", i) for i in range(10)]
    rows += [(300, "too short", "en", "a", 5, None, 1), (301, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, size long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "quality rules":
            assert not ids & {300, 301} and ids >= set(range(80))
        if name == "near duplicates":
            assert ids == set(range(80)) | {300, 301}
        if name == "decontamination":
            assert len(ids) == len(rows)
    assert stage is corpus_pipeline.balance and len(ids) > 20


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size long"


def test_stages_of_nothing(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0, name
        assert name == "token shards" or out.columns == docs.columns


def test_stages_with_repeated_rows_nulls_and_long_texts(spark):
    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    one, long = text(90), text(60_000)
    rows = [(1, one), (1, one), (1, text(70)), (2, long), (3, f"{long} end"), (4, None), (4, ""), (None, text(60)), (None, None), (5, text(80))]
    docs = spark.createDataFrame([(i, t, "en", "a", 1, None, 2) for i, t in rows], SCHEMA)
    ids = lambda df: sorted((r.doc_id or 0, len(r.text or "")) for r in df.collect())
    every = ids(docs)
    assert ids(corpus_pipeline.rules(spark, docs, SF)) == [x for x in every if x[0] != 4]
    left = ids(corpus_pipeline.dedup(spark, docs, SF))
    assert [x[0] for x in left] == [0, 0, 1, 2, 4, 5] and [x for x in left if x[0] != 1 and x[0] != 4] == [x for x in every if x[0] not in (1, 3, 4)]
    assert ids(corpus_pipeline.decontaminate(spark, docs, SF)) == every
    mixed = corpus_pipeline.balance(spark, docs, SF)
    assert mixed.columns == docs.columns and not mixed.where("doc_id = 4").count()
    found = sorted(map(tuple, corpus_pipeline.tokens(spark, docs, SF).select("start", "n_tokens").collect()))
    assert len(found) == len(rows) and all(a + n == b for (a, n), (b, _) in zip(found, found[1:], strict=False))


def test_rules_leave_texts_where_they_are(spark):
    """With tables too large to broadcast the same rows stay, and no text is dealt out."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.quality_rules(docs).where("kept").collect()}
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.rules(spark, docs, SF)
        nodes, dealt = [out._jdf.queryExecution().executedPlan().initialPlan()], []
        while nodes:
            n = nodes.pop()
            nodes += [n.children().apply(i) for i in range(n.children().size())]
            if n.nodeName() == "Exchange":
                dealt.append(n.output().mkString(" "))
        assert not [x for x in dealt if "text#" in x or "row#" in x]
        rows = sorted(map(str, out.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert rows == sorted(str(r) for r in docs.collect() if r.doc_id in kept) and 0 < len(rows) < docs.count()


def test_leaks_and_copies_go(spark):
    """Each stage against what was put in: exact and edited copies, benchmark items, verbatim and with a word changed."""
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()][:6]
    clean = [(i, text(120)) for i in range(30)]
    copies = [(100 + i, f"{clean[i][1]} more") for i in range(10)] + [(200 + i, clean[i][1]) for i in range(10)]
    leaks = [(300 + i, f"{text(50)} {x} {text(50)}") for i, x in enumerate(items)]
    leaks += [(400 + i, f"{text(50)} {' '.join('other' if k == 4 else w for k, w in enumerate(x.split()))} {text(50)}") for i, x in enumerate(items)]
    docs = spark.createDataFrame([(i, t, "en", "a", 1, None, 2) for i, t in clean + copies + leaks], SCHEMA)
    ids = lambda df: {r.doc_id for r in df.collect()}
    assert ids(corpus_pipeline.dedup(spark, docs, SF)) == {i for i, _ in clean + leaks}
    assert ids(corpus_pipeline.decontaminate(spark, docs, SF)) == {i for i, _ in clean + copies}


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    rows = sorted(out.collect(), key=lambda r: r.start)
    assert rows and rows[0].start == 0
    assert all(a.start + a.n_tokens == b.start and a.doc_id <= b.doc_id for a, b in zip(rows, rows[1:], strict=False))


@pytest.mark.parametrize("name", list(llm.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(llm.oracle_sql()[name])
    out = llm.queries()[name](spark, SF).select(*want.columns)
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want.fetchall()))
