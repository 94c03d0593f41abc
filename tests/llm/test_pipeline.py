"""The corpus pipeline, stage by stage, against its operators' promises."""

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from mediatables.llm import mixing
from mediatables.llm.shared import components

DATA = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    junk = spark.createDataFrame([(90_001, "1234 5678", "en", "src1", 9), (90_002, None, "fr", "src2", 0)], docs.schema)
    docs, seen = docs.union(junk), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == list(corpus_pipeline.COLUMNS)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = seen[name] = spark.read.parquet(f"{tmp_path}/{name}")
    assert seen["language_id"].where("doc_id > 90000").count() == 0 and seen["language_id"].count() == 200
    ids = [r.doc_id for r in seen["near_duplicates"].select("doc_id").collect()]
    assert len(ids) == len(set(ids)) < 200
    assert seen["repeated_strings"].count() == len(ids)
    assert seen["repeated_strings"].where("text is null or text like '%�%'").count() == 0
    plan = mixing.mixture(seen["repeated_strings"]).agg(F.sum("copies")).first()[0]
    assert seen["mixing"].count() == plan == seen["tokens"].count()
    assert seen["tokens"].where("not round_trip").count() == 0


@pytest.mark.parametrize("n", [1, 40])
def test_components_of_paths_and_nulls(spark, n):
    edges = spark.createDataFrame([(k + 1, k) for k in range(n)] + [(100, 101), (101, 100), (7000, 7000), (None, 5), (5, None)], "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {k: 0 for k in range(n + 1)} | {100: 100, 101: 100}


@pytest.mark.parametrize("order", ["random", "descending"])
def test_components_of_long_paths(spark, order):
    ids = [0, *range(499, 0, -1)] if order == "descending" else np.random.default_rng(1).permutation(500).tolist()
    edges = spark.createDataFrame(list(zip(ids, ids[1:])), "u long, v long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == dict.fromkeys(range(500), 0)


def test_repeats_of_51_words_go(spark):
    short, usual = " ".join("abcdefghijklmnopq" * 3), " ".join(f"w{k:02}" for k in range(54))
    rows = [(k, f"begin {k} {p} end {k}", "en", "s", 0) for k, p in enumerate([short, usual, short, usual])] + [(9, "clean text", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs, DATA).collect()}
    assert not any(p in t for p in (short, usual) for t in got.values())
    assert got[9] == "clean text" and all(t.startswith(f"begin {k}") and t.endswith(f"{k}") for k, t in got.items() if k < 9)


def test_rows_without_id_and_repeated_rows(spark):
    texts = [" ".join(f"{t}{k}" for k in range(60)) for t in "abcd"]
    rows = [(1, texts[0]), (1, texts[0]), (2, texts[1]), (None, texts[1]), (None, texts[2]), (None, texts[2]), (None, None), (3, texts[3])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, DATA)
    assert left.columns == list(corpus_pipeline.COLUMNS)
    got = [(r.doc_id, r.text or "") for r in corpus_pipeline.cut_repeats(spark, left, DATA).collect()]
    assert sorted(got, key=str) == sorted([(1, texts[0]), (2, texts[1]), (None, texts[2]), (None, ""), (3, texts[3])], key=str)


@pytest.mark.parametrize("empty", [True, False])
def test_stages_take_clashing_columns(spark, empty):
    """Each stage on nothing, and each but the first, whose model needs labels, on long, empty and equal texts with further columns."""
    long = " ".join(f"word{k}" for k in range(60_000))
    rows = [(1, long, "en", "s", 0), (2, "", "en", None, 0), (3, "one two", None, "s", 7), (4, "one two", "en", "s", 7)]
    docs = spark.createDataFrame([] if empty else rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("row", "key", "label", "kept", "digest", "number", "copies", "token_ids"):
        docs = docs.withColumn(name, F.lit("x"))
    got = {name: stage(spark, docs, DATA).collect() for name, stage in corpus_pipeline.STAGES[0 if empty else 1 :]}
    if empty:
        assert not any(got.values())
        return
    assert sorted(r.doc_id for r in got["near_duplicates"]) == [1, 2, 3]
    assert {r.doc_id: r.text for r in got["repeated_strings"]} == {i: t for i, t, *_ in rows}
    assert {r.doc_id for r in got["mixing"]} <= {1, 2, 3, 4}
    assert {r.doc_id: r.n_tokens > 0 and r.round_trip for r in got["tokens"]} == {1: True, 2: False, 3: True, 4: True}
