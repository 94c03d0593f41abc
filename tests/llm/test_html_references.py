"""Every template of a host has references of its own, however many and however large; wide nodes match in the best way."""

import random

from mediatables.llm import html


def _texts(spark, rows):
    return {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def _tale(family, k, n=20):
    return f"Tale {family} {k} " + f"goes on for very many words of {k} " * n + "and ends."


def _page(family, k, wide=0):
    """A page of one of many templates, unlike each other in all their names; its story lies in what looks like an advert."""
    name = lambda i: "".join(chr(97 + int(c)) for c in f"{family:02d}{i}")
    chrome = "".join(f'<section class="q{name(i)}"><div class="z{name(i)}">Part {i} of site {family}</div></section>' for i in range(6 + wide))
    return f'<html><body>{chrome}<div class="k{name(7)}"><article class="m{name(8)}"><h1>Same head {family}</h1><p>Always the same in {family}.</p></article><div class="related"><p>{_tale(family, k, 2_000 if wide else 20)}</p></div></div></body></html>'


def test_every_template_of_a_host_has_a_reference(spark):
    families = 9
    rows = [(100 * f + k, "http://h.example/p", _page(f, k)) for f in range(families) for k in range(5 + f)]
    rows.append((5000, "http://h.example/p", _page(77, 0)))  # one page of a kind
    got = _texts(spark, rows)
    assert len(got) == len(rows)
    for f in range(families):
        for k in range(5 + f):
            assert got[100 * f + k] == _tale(f, k)


def test_layouts_of_many_nodes_serve_as_references(spark):
    rows = [(k, "http://h.example/p", _page(1, k, wide=900)) for k in range(6)]
    assert len(html.layout_of(html.parse(rows[0][2]))[0]) > 2_000
    assert _texts(spark, rows) == {k: _tale(1, k, 2_000) for k in range(6)}


def test_the_commonest_layouts_are_taken_whatever_their_names(spark):
    from pyspark.sql import functions as F

    layouts = spark.range(200).select(F.lit("h").alias("host"), (F.col("id") * 64).alias("layout"), (F.col("id") + 1).alias("n"), F.concat(F.lit("-1 0 #root\n0 0 #text"), F.col("id").cast("string")).alias("shape"))
    refs = html._commonest(layouts, 3, 0).orderBy("ref").collect()
    assert [(r.ref, r.layout // 64 + 1) for r in refs] == [(0, 200), (1, 199), (2, 198)]


def test_wide_nodes_match_in_the_best_way():
    rng = random.Random(5)
    x, y = (["abcdefgh"[rng.randrange(8)] for _ in range(n)] for n in (400, 300))
    a, b = ([(-1, 0, "r")] + [(0, 0, c) for c in names] for names in (x, y))
    longest = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for p in range(len(x)):
        for q in range(len(y)):
            longest[p + 1][q + 1] = longest[p][q] + 1 if x[p] == y[q] else max(longest[p][q + 1], longest[p + 1][q])
    score, at = html.matched(a, b)
    pairs = [(i, j) for i, j in enumerate(at) if j >= 0]
    assert score == 1 + longest[-1][-1] == len(pairs)
    assert all(a[i][2] == b[j][2] for i, j in pairs) and [j for _, j in pairs] == sorted({j for _, j in pairs})
