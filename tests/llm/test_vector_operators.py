"""Operators on vectors against brute force, and their edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediatables.llm import ann, embdedup

SCHEMA = "vec_id long, embedding array<float>, label int, score double, bucket long, size int, rank int"


def _table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 0.0, 1, 2, 3) for i, v in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 32)).astype(np.float32)
    x[100:140] = x[100] + 0.05 * rng.standard_normal((40, 32))
    x[200:230] = x[200]
    out = [(i, v) for i, v in enumerate(x)]
    return out + [(700, None), (701, [0.0] * 32), (702, [float("nan")] * 32), (703, [None] * 32), (704, [1.0, 2.0]), (705, []), (300, x[300])]


def _used(rows):
    return {i: np.asarray(v, float) for i, v in rows if i < 700}


def test_nearest_has_exact_scores_and_recall(spark, rows):
    used = _used(rows)
    ids, x = np.array(list(used)), np.stack(list(used.values()))
    got = ann.nearest(_table(spark, rows), F.col("vec_id") % 20 == 0, slice_rows=100).collect()
    hit = 0
    for q in ids[ids % 20 == 0]:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        d = np.sqrt(((x - used[q]) ** 2).sum(axis=1))
        assert np.allclose([d[r.vec_id] for r in mine], [r.score for r in mine])
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        d[q] = np.inf
        hit += len(set(np.lexsort((ids, d))[:10]) & {r.vec_id for r in mine})
    assert hit >= 0.9 * 10 * (ids % 20 == 0).sum()


def test_nearest_of_few_and_none(spark):
    few = _table(spark, [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (21, [1.0, 1.0]), (22, None)])
    got = ann.nearest(few, F.col("vec_id") % 20 == 0, success=0.01).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == [(0, 1, 21), (0, 2, 20), (20, 1, 21), (20, 2, 0)]
    assert ann.nearest(few.where("false"), F.lit(True)).count() == 0


@pytest.mark.parametrize("part", [50, 16_384])
def test_links_equal_brute_force(spark, rows, part):
    used = _used(rows)
    ids, x = np.array(list(used)), np.stack(list(used.values()))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    label = ids.copy()
    for _ in range(50):
        label = np.array([min(label[k], label[near[k]].min(initial=10**9)) for k in range(len(ids))])
    got = {r.vec_id: r for r in embdedup.near_vectors(_table(spark, rows), 0.9, part=part).collect()}
    assert set(got) == {i for i, _ in rows}
    for k, i in enumerate(ids):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[k].sum(), label[k], label[k] == i)
    assert all(got[i].n_links == 0 and got[i].kept for i in range(700, 706))


def test_links_of_nothing(spark, rows):
    assert embdedup.near_vectors(_table(spark, rows).where("false")).count() == 0
    assert embdedup.near_vectors(_table(spark, [(1, None), (2, [0.0])])).count() == 2


def test_each_dimension_is_joined_and_searched(spark):
    table = _table(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (20, [1.0, 0.0, 0.0]), (21, [1.0, 0.0, 0.0]), (40, [1.0])])
    got = {r.vec_id: (r.n_links, r.component_id) for r in embdedup.near_vectors(table).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (0, 2), 20: (1, 20), 21: (1, 20), 40: (0, 40)}
    near = ann.nearest(table, F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in near) == [(0, 1, 1), (0, 2, 2), (20, 1, 21)]


def test_one_of_several_vectors_of_an_id_counts(spark):
    """The one of the lowest dimension, then of the least bytes, in whatever order the rows come."""
    rows = [(0, [0.0, 1.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 0.0, 0.0]), (2, [1.0, 0.0])]
    for order in (rows, rows[::-1]):
        found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(_table(spark, order), F.col("vec_id") == 0).collect())
        assert found == [(0, 1, 1, 0.0), (0, 2, 2, pytest.approx(2**0.5))]
        links = {r.vec_id: (r.n_links, r.component_id) for r in embdedup.near_vectors(_table(spark, order)).collect()}
        assert links == {0: (1, 0), 1: (1, 0), 2: (0, 2)}
