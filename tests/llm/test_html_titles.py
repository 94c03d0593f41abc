"""Titles inside a host's content stay, other constant text goes; wide pages are matched in bounded time."""

import random
import time

from mediatables.llm import html


def _texts(spark, pages, **options):
    df = spark.createDataFrame([(i, f"http://h.example/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in html.main_text(df, **options).orderBy("page_id").collect()]


def _words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n))


def test_headings_that_all_pages_share_stay_in_the_content(spark):
    rng = random.Random(4)
    pages = [f"<body><div>Our Kitchen Home</div><article><h1>{_words(rng, 3)}</h1><h2>Ingredients</h2><p>{_words(rng, 40)}</p><h2>Method</h2><p>{_words(rng, 60)}</p></article><div>All rights</div></body>" for _ in range(8)]
    for text in _texts(spark, pages):
        assert " Ingredients " in text and " Method " in text and "Kitchen" not in text and "rights" not in text


def test_shared_text_that_names_nothing_stays_template(spark):
    rng = random.Random(5)
    links = "<ul><li><a href=a>one thing</a></li><li><a href=b>other thing</a></li></ul>"
    pages = [
        f"<body><div class=x><h1>{_words(rng, 3)}</h1><p>The same lead everywhere</p><dl><dt>Maker</dt><dd>{_words(rng, 9)}</dd></dl><table><caption>Sizes</caption><tr><th>Width</th><td>{_words(rng, 3)}</td></tr></table><p>{_words(rng, 60)}</p>"
        f"<h3>Elsewhere on this site</h3>{links}<h2><a href=c>Buy it here</a></h2><h2 class=promo>Newsletter</h2><p>{_words(rng, 20)}</p><h4>The end</h4></div></body>"
        for _ in range(8)
    ]
    for text in _texts(spark, pages):
        for title in ("Maker", "Sizes", "Width"):
            assert f" {title} " in text
        for template in ("same lead", "Elsewhere", "one thing", "Buy it here", "Newsletter", "The end"):
            assert template not in text


def test_wide_pages_are_matched_in_bounded_time():
    def page(n, seed):
        rng = random.Random(seed)
        return "<body><article>" + "".join(f"<h2>{rng.random()}</h2><p>x</p>" + "<ul><li>a</ul>" * (rng.random() < 0.1) for _ in range(n)) + "</article></body>"

    a, b = (html.layout_of(html.parse(page(*x)))[0] for x in ((6400, 1), (400, 2)))
    began = time.perf_counter()
    score, at = html.matched(a, b)
    assert time.perf_counter() - began < 5 and score > 0.7 * len(b)
    pairs = [(i, j) for i, j in enumerate(at) if j >= 0]
    assert len({j for _, j in pairs}) == len(pairs) == score
    assert all(a[i][2] == b[j][2] and (not i or at[a[i][0]] == b[j][0]) for i, j in pairs)
    assert [j for _, j in pairs] == sorted(j for _, j in pairs)


def test_children_in_order_equal_the_best_match_around_anchors():
    rng = random.Random(9)
    for _ in range(200):
        names = [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        x, y = list(range(len(names))), [k for k in range(len(names)) if rng.random() < 0.8]
        shapes = list(range(len(names)))  # every subtree is its own: all that is left on both sides is an anchor
        assert html._in_order(x, y, names, names, shapes, shapes) == [(k, k) for k in y]
