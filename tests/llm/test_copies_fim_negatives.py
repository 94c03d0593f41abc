"""Exact copies, fill-in-middle and hard negatives against plain versions, and their edge cases."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediatables.llm import exact, fim, hardneg, queries

DATA = "/root/testdata/sf0.001"
WIDE = "doc_id long, text string, row string, kind int, uid long, rep string, n long, form string, output string, head string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "r", 1, 2, "x", 3, "f", "o", "h") for i, t in rows], WIDE)


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --------------------------------------------------------------------------- exact copies


def test_trie_holds_what_a_dict_holds():
    rng = random.Random(2)
    trie, plain = exact.Trie(), {}
    for n in range(4000):
        key = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9)))
        trie.terminal(key).append(n)
        plain.setdefault(key, []).append(n)
        if n % 1500 == 1499:  # subtrees that leave take all their keys along, and no others
            for k, held in trie.heaviest():
                assert plain.pop(k) == held
    assert list(trie.rest()) == sorted(plain.items()) and trie.held == 0


def test_trie_lets_go_of_what_lies_before():
    trie = exact.Trie()
    keys = sorted({bytes(random.Random(n).choices(b"abc", k=6)) for n in range(300)})
    out = []
    for k in keys:
        out += [x for x, _ in trie.before(k)]
        trie.terminal(k).append(1)
        assert len(out) <= keys.index(k)
    out += [x for x, _ in trie.rest()]
    assert out == keys


@pytest.mark.parametrize("spill", [1, 2_000, 1 << 24])
def test_owners_equal_plain_groups(spark, spill):
    rng = random.Random(5)
    rows = [(i, rng.choice(["Same Text", "same text", "SAME TEXT", "ÄÖ x", "äö x", "", None, " ", "long " * 5000, f"own {i}"])) for i in range(400)]
    want = {}
    for i, t in rows:
        want.setdefault((t or "").encode().lower(), []).append(i)
    got = exact.owners(_docs(spark, rows).repartition(5), spill=spill).select("row.*", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(r.doc_id for r in got) == [i for i, _ in rows]
    text = dict(rows)
    for r in got:
        group = want[(text[r.doc_id] or "").encode().lower()]
        assert (r.keep_id, r.group_size, r.kept) == (max(group), len(group), r.doc_id == max(group))
        assert r.text_sha256 == hashlib.sha256((text[r.doc_id] or "").encode().lower()).hexdigest()
    small = exact.owners(_docs(spark, rows), largest=False).where("kept").select("row.doc_id").collect()
    assert sorted(r.doc_id for r in small) == sorted(min(g) for g in want.values())


def test_owners_of_odd_rows(spark):
    rows = [(None, "a"), (None, "A"), (7, "b"), (7, "B"), (3, "b"), (None, "b"), (-2, "c"), (-9, "c")]
    got = exact.owners(_docs(spark, rows)).select("row.doc_id", "keep_id", "group_size", "kept").collect()
    assert sum(r.kept for r in got) == 3 and {(r.keep_id, r.group_size) for r in got} == {(None, 2), (7, 4), (-2, 2)}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact.owners(_docs(spark, rows).where("false")).count() == 0


# --------------------------------------------------------------------------- fill in middle


def test_rank_index_gives_every_boundary():
    rng = random.Random(3)
    texts = ["", "plain ascii " * 50, "ä" * 400, "日本" * 300 + "x" * 3000, "😀", "".join(rng.choice("aé漢😀\n") for _ in range(5000))]
    index = fim.RankIndex([t.encode() for t in texts])
    assert not hasattr(index, "offset") and np.abs(index.residual).max() <= fim.ERROR
    for k, t in enumerate(texts):
        want = [len(t[:j].encode()) for j in range(len(t) + 1)]
        assert index.count[k] == len(t)
        assert index.at(np.full(len(t) + 1, k), np.arange(len(t) + 1)).tolist() == want
    assert len(fim.RankIndex([b"x" * 100_000]).begin) == 1


def _cut(i, t):
    n = len(t)
    x = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def test_fill_in_middle_equals_slices(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("ab é漢😀<PSM>\r\n") for _ in range(rng.randint(0, 200)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "has <M> inside"), (903, "ü" * 200_000), (904, "x"), (904, "x"), (None, "no id"), (905, "<" * 50), (906, "<S" * 40)]
    made = fim.fill_in_middle(_docs(spark, rows))
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form"))).select(F.col("row.doc_id").alias("i"), "n", "form", "prefix_chars", "middle_chars", "output", "back").collect()
    want = sorted((i or -1, *_cut(i, t or ""), t or "") for i, t in rows)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.i or -1, *r[1:]) for r in got), key=key) == sorted(want, key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(_docs(spark, rows).where("false")).count() == 0


# --------------------------------------------------------------------------- hard negatives


def _vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], c, 1, 2, 3.0, "r") for i, v, c in rows], "vec_id long, embedding array<float>, label int, cell int, part int, score double, dim string")


def _mined(rows, every, k=5, n=3):
    used = {}
    for i, v, c in rows:
        if i is not None and c is not None and v and all(x is not None and np.isfinite(x) for x in v):
            used[i] = min(used.get(i, (c, v)), (c, v))
    whole = {i: (c, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, (c, v) in used.items()}
    out = []
    for a, (c, v) in whole.items():
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), i, d) for i, (d, w) in whole.items() if i != a and len(w) == len(v))
        for s, i, _ in [x for x in scored if x[2] == c][:k]:
            fit = [x for x in scored if x[2] != c and -50 * s <= -100 * x[0] <= -95 * s][:n]
            out += [(a, i, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("part", [40, 16_384])
def test_hard_negatives_equal_brute_force(spark, part, monkeypatch):
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((4, 24))
    rows = [(i, (centres[i % 4] + 0.6 * rng.standard_normal(24)).astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(500)]
    rows += [(1000 + i, rows[40][1], i % 2) for i in range(60)]  # ties
    rows += [(2000, None, 1), (2010, [None] * 24, 1), (2020, [float("nan")] * 24, 1), (2030, rows[1][1], None), (2040, [], 1), (2050, [1.0, 2.0], 1), (2051, [1.0, 1.0], 1), (2052, [1.0, 0.5], 2), (2060, [0.0] * 24, 2)]
    rows += [(300, rows[7][1], 2), (None, rows[3][1], 1), (300, rows[7][1], 2)]
    got = hardneg.hard_negatives(_vectors(spark, rows), F.col("vec_id") % 10 == 0, F.col("label"), part=part)
    assert sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == _mined(rows, 10)


def test_hard_negatives_in_many_cells(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(i, rng.standard_normal(6).astype(np.float32).tolist(), i % 2) for i in range(300)]
    table = _vectors(spark, rows)
    vectors = hardneg.cut(hardneg.whole_vectors(table, "embedding", "vec_id", F.col("label")).withColumn("is_anchor", F.col("vec_id") % 10 == 0))
    got = hardneg._of_dimension(vectors, 6, 300 * hardneg.GROUPS, 5, 3, (50, 95), 5)
    assert sorted(tuple(r) for r in got.collect()) == _mined(rows, 10)


def test_bounds_hold_and_large_scores_are_exact():
    rng = np.random.default_rng(1)
    a, b = np.floor(256 * rng.standard_normal((40, 37))), np.floor(256 * rng.standard_normal((60, 37)))
    exact_ = hardneg.scores(a, b)
    assert (exact_ == (a.astype(int) @ b.astype(int).T)).all()
    wide = None
    for width in (37, 16, 4, 1):
        low, high = hardneg.bounds(hardneg.summary(a, width), hardneg.summary(b, width))
        assert (low <= exact_ + 1e-6).all() and (exact_ <= high + 1e-6).all()
        assert wide is None or width != 4 or (high - low).mean() < wide
        wide = (high - low).mean()
    assert wide < 1e-6
    big = np.array([[2.0**40, 1.0]])
    assert hardneg.scores(big, np.array([[2.0**20, 3.0], [2.0**40, 0.0]])).tolist() == [[2**60 + 3, 2**63 - 1]]


def test_hard_negatives_of_nothing(spark):
    empty = _vectors(spark, [(1, None, 1)])
    assert hardneg.hard_negatives(empty, F.lit(True), F.col("label")).count() == 0
    assert hardneg.hard_negatives(_vectors(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [1e38], 2)]), F.lit(True), F.col("label")).count() == 0


@pytest.mark.parametrize("name", ["op11_exact", "op12_fim", "op13_hard_negatives"])
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA), con.sql(queries.ORACLES[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.select(order).collect()), key=key) == sorted((tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall()), key=key)
