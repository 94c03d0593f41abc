"""Every registered query against its SQL, at the smallest scale."""

import math

import duckdb
import pytest

from mediatables import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.6g}"
    return str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, con, name):
    got = registry.QUERIES[name](spark, DATA)
    want = con.sql(registry.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got.columns, got.collect()) == _rows(want.columns, want.fetchall())


def test_prose_chunks_keep_words_and_limit(spark):
    rows = registry.QUERIES["chunk_corpus_prose"](spark, DATA)
    assert rows.where("char_count > 300").count() == 0 and rows.count() > 0


def test_merged_chunks_are_fewer_and_fit(spark):
    merged = registry.QUERIES["chunk_corpus_merged"](spark, DATA)
    assert merged.where("char_count > 300").count() == 0
    assert merged.count() <= registry.QUERIES["chunk_corpus_narration"](spark, DATA).count()


def test_open_end_counts_of_all_ranges(spark, con):
    from mediatables.queries_media import _interval_sql

    got = registry.QUERIES["overlap_open_end_whole"](spark, DATA)
    want = con.sql(f"SELECT l.track, l.id AS left_id, count(*) AS n FROM {_interval_sql('signup')} l JOIN {_interval_sql('purchase')} r ON l.track = r.track AND r.e > l.s GROUP BY ALL")
    assert any(r[1] % 40 for r in want.fetchall())
    assert _rows(got.columns, got.collect()) == _rows(want.columns, want.fetchall())


def test_open_end_counts_make_no_pairs(spark):
    plan = registry.QUERIES["overlap_open_end_whole"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan  # a search of pairs deals its ranges out by stretches


def _pairs_sql(name):
    from mediatables import queries_media as q

    def pairs(left, right, on):
        return f"SELECT l.track, l.id AS left_id, r.id AS right_id FROM {left} l JOIN {right} r ON l.track = r.track AND {on}"

    return {
        "overlap_open_end_pairs": pairs(q._interval_sql("signup"), q._interval_sql("purchase"), "r.e > l.s"),
        "overlap_conflicts_volume": pairs(q._VOLUME, q._VOLUME, "r.s < l.e AND r.e > l.s AND l.id % 2 = 0 AND r.id % 2 = 1"),
        "overlap_conflicts_long": pairs(q._LONG, q._LONG, "r.s < l.e AND r.e > l.s AND l.e > l.s AND r.e > r.s AND l.id % 2 = 0 AND r.id % 2 = 1"),
    }[name]


@pytest.mark.parametrize("name", ["overlap_open_end_pairs", "overlap_conflicts_volume", "overlap_conflicts_long"])
def test_pairs_come_out_one_a_row(spark, con, name):
    got, want, stated = registry.QUERIES[name](spark, DATA), con.sql(_pairs_sql(name)), con.sql(registry.ORACLES[name])
    assert got.columns == ["track", "left_id", "right_id"]
    rows = _rows(want.columns, want.fetchall())
    assert rows and _rows(got.columns, got.collect()) == rows == _rows(stated.columns, stated.fetchall())
