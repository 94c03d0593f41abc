"""Operators on texts against brute force, and their edge cases."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations
from urllib.parse import urlsplit

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediatables.llm import bpe, html, langid, minhash, mixing, queries, suffix, tokencount, warc
from mediatables.llm.queries import vocabulary_path

DATA = "/root/testdata/sf0.001"
WIDE = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, digest string, leader long, size int"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, 0, "r", "k", "d", 7, 3) for i, t, lang, src in rows], WIDE)


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def _sets(rows):
    out = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def _linked(sets, percent):
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("block", [2, 2000])
def test_minhash_equals_brute_force(spark, given, block):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    base = [words[i] for i in rng.integers(0, 60, 60)]
    rows = [(r.doc_id, r.text, "en", "s") for r in given.select("doc_id", "text").collect()]
    for i in range(12):  # a chain of near copies, some joined through others only
        base = [*base]
        base[int(rng.integers(0, 60))] = f"x{i}"
        rows.append((1000 + i, " ".join(base), "en", "s"))
    rows += [(2000, None, None, None), (2001, "", "en", "s"), (2002, " \t\n", "en", "s"), (2003, "One two", "en", "s"), (2004, "one TWO", "en", "s"), (2004, "one TWO", "en", "s"), (2005, "É one two", "en", "s")]
    got = {r.doc_id: r for r in minhash.near_duplicates(_docs(spark, rows), percent=85, block=block).collect()}
    sets = _sets([(i, t) for i, t, *_ in rows])
    want = _linked(sets, 85)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (i == want[i]) for i, r in got.items())


def test_minhash_of_nothing(spark):
    assert minhash.near_duplicates(_docs(spark, []).where("false")).count() == 0


def test_odd_sketch_estimates_high_similarity():
    rng = np.random.default_rng(1)
    a = np.sort(rng.integers(1, 2**63, 900, dtype=np.uint64))
    for kept in (855, 810):
        b = np.sort(np.concatenate((a[:kept], rng.integers(1, 2**63, 900 - kept, dtype=np.uint64))))
        odd = minhash.odd_sketches(minhash.samples([a, b]))
        assert np.bitwise_count(odd[0] ^ odd[1]).sum() <= minhash.most_ones(0.7)


def _removed(texts, length):
    count = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        yield len(t), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), bytes(c for c, g in zip(t, gone, strict=True) if not g)


@pytest.mark.parametrize(("length", "group"), [(400, 20_000), (40, 20_000), (40, 2), (12, 1)])
def test_suffix_equals_brute_force(spark, given, length, group):
    some = "".join(chr(97 + int(x)) for x in np.random.default_rng(5).integers(0, 26, 500))
    rows = [(r.doc_id, r.text, "en", "s") for r in given.where("n_chars < 3000").select("doc_id", "text").limit(60).collect()]
    rows += [(900, some, "en", "s"), (901, "x" * 45 + some[:450], "en", "s"), (902, some[50:] + "é" * 230, None, None), (903, None, "en", "s"), (904, "", "en", "s"), (905, "ab" * 300, "en", "s"), (906, some, "en", "s"), (906, some, "en", "s")]
    got = sorted((r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.remove_repeats(_docs(spark, rows), length=length, group=group).collect())
    want = sorted((i, *x) for (i, *_), x in zip(rows, _removed([(t or "").encode() for _, t, *_ in rows], length), strict=True))
    assert got == want


def test_suffix_keeps_runs_of_few_words(spark):
    few, many = " ".join(f"word{k}" for k in range(20)), " ".join(f"w{k}" for k in range(60))
    docs = _docs(spark, [(k, f"x{k} {few} y{k} {many} z{k}", "en", "s") for k in range(3)])
    got = {r.row.doc_id: (bytes(r.kept).decode(), r.n_spans) for r in suffix.remove_repeats(docs, length=60, words=51).collect()}
    assert all(n == 1 and t == f"x{k} {few} y{k}{k}" for k, (t, n) in got.items())
    assert suffix.whole_words(b"ab cd ef", 1, 7) == 1 and suffix.whole_words(b"ab cd ef", 0, 8) == 3 and suffix.whole_words(b"ab cd ef", 2, 6) == 1 and suffix.whole_words(b"", 0, 0) == 0


def test_suffix_pieces_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(suffix, "_PIECE", 1000)
    text = bytes(np.random.default_rng(2).integers(97, 123, 5000, dtype=np.uint8))
    parts = list(suffix._pieces(text, 400))
    assert sum(len(p) - 399 for _, p in parts) == len(text) - 399


STRANGE = ["", None, "<|endoftext|>", "a<|endoftext|> b", "I'll don't  we've  \n\n x", "漢字🙂 ​", "ab" * 700, " " * 90 + "x", "é" * 200, "\x00\x1f\x85"]


def test_tokens_equal_the_library(spark, given):
    from tokenizers import Tokenizer

    path = vocabulary_path()
    lib = Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()
    rows = [(r.doc_id, r.text, "en", "s") for r in given.select("doc_id", "text").collect()] + [(5000 + k, t, "en", "s") for k, t in enumerate(STRANGE)]
    docs = _docs(spark, rows)
    ids = {i: lib.encode(t or "", add_special_tokens=False).ids for i, t, *_ in rows}
    got = {r.doc_id: r for r in bpe.round_trip(docs, path).collect()}
    for i, want in ids.items():
        assert got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(want, skip_special_tokens=False).encode()).hexdigest()
    counts = {r.doc_id: r for r in tokencount.token_counts(docs, path, 512).collect()}
    assert all(counts[i].n_tokens == len(x) and counts[i].over_limit == (len(x) > 512) for i, x in ids.items())
    assert all(counts[i].n_bytes == len((t or "").encode()) for i, t, *_ in rows)
    array = bpe.with_decoded_text(bpe.with_token_ids(docs.where("doc_id >= 5000"), path), path).collect()
    assert all(list(r.token_ids) == ids[r.doc_id] and r.decoded == (r.text or "") for r in array)
    assert bpe.round_trip(docs.where("false"), path).count() == 0 and tokencount.token_counts(docs.where("false"), path).count() == 0


@pytest.mark.parametrize("word", ["", "a", "to", "strawberry", "strawberries" * 9, "aaaa" * 40, "thethethe" * 20, "é漢🙂" * 7])
def test_tree_merges_as_the_plain_rule_does(word, monkeypatch):
    v, updates, update = bpe.Vocabulary(vocabulary_path()), [], bpe.point_update
    monkeypatch.setattr(bpe, "point_update", lambda *x: (updates.append(x[1]), update(*x)))
    parts = [v.letter_ids[b] for b in word.encode()]
    ids, merges = list(parts), 0
    while ranked := [(v.merges[p][0], k) for k, p in enumerate(zip(ids, ids[1:])) if p in v.merges]:
        _, k = min(ranked)
        ids[k : k + 2] = [v.merges[ids[k], ids[k + 1]][1]]
        merges += 1
    assert bpe.merged(parts, v.merges) == ids
    assert merges <= len(updates) <= 3 * merges  # every merge goes through the tree


def test_words_side_by_side_merge_as_one_at_a_time():
    v, draw = bpe.Vocabulary(vocabulary_path()), np.random.default_rng(5)
    words = [b"a" * k for k in range(1, 140)]
    words += [bytes(draw.integers(0, 256, n, dtype=np.uint8)) for n in draw.integers(1, 80, 300)]
    words += ["".join(draw.choice([*" etaoinsr"], n)).encode() for n in draw.integers(1, 80, 1000)]
    alone = [bpe.merged([v.letter_ids[b] for b in word], v.merges) for word in words]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in bpe.merged_words(words, v)] == alone
    assert bpe.merged_words([], v) == []


def test_a_small_memo_changes_no_ids():
    v = bpe.Vocabulary(vocabulary_path())
    texts = ["one two three four", None, "two five", "", "one one six" * 50]
    memo = bpe.Encoder(v, 2)
    memo_ids = [ids.tolist() for text in texts for ids in memo.encode([text])]
    assert memo_ids == [ids.tolist() for ids in bpe.Encoder(v).encode(texts)]


def test_mixing_targets_bounds_and_reruns(spark, given):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in given.collect()] + [(9001, None, "en", None), (9002, "a b c", "en", None), (9003, "", "en", "zz"), (None, "x y", "en", "src1"), (9004, "same row", "en", "src1"), (9004, "same row", "en", "src1")]
    docs = _docs(spark, rows)
    got = mixing.mixture(docs, bucket=20).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixture(docs.repartition(7), bucket=20).collect()))
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r.size
    total = sum(len((t or "").encode().split()) for _, t, *_ in rows)
    sizes = {s: sum(r.size for r in x) for s, x in by.items()}
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(by, key=lambda s: (s is None, s)))}
    capped = set()
    while True:  # share again until none is above
        left = total - sum(3 * sizes[s] for s in capped)
        free = sum(w for s, w in weights.items() if s not in capped)
        want = {s: 3 * sizes[s] if s in capped else left * weights[s] / free for s in sizes}
        more = {s for s in sizes if s not in capped and want[s] > 3 * sizes[s]}
        if not more:
            break
        capped |= more
    for s, x in by.items():
        assert x[0].source_size == sizes[s] and x[0].target == pytest.approx(want[s])
        assert abs(sum(r.taken for r in x) - want[s]) <= max(r.size for r in x) / 2 + 1
    assert mixing.mixture(docs.where("false")).count() == 0
    assert mixing.mixed(docs).count() == mixing.mixture(docs).agg(F.sum("copies")).first()[0]


def _dense_rates(sizes, target, most):
    """A dense solver of one source's dual: plain Newton with halving, on all documents at once."""
    x, lam = sizes / sizes.mean(), 0.0
    value = lambda k: (sizes * np.minimum(most, np.exp(np.minimum(k * x, 50)))).sum()
    for _ in range(500):
        r = np.minimum(most, np.exp(lam * x))
        slope = (sizes * r * x)[r < most].sum()
        step = (target - value(lam)) / slope if slope else 1.0
        while abs(value(lam + step) - target) > abs(value(lam) - target) and abs(step) > 1e-14:
            step /= 2
        lam += step
    return np.minimum(most, np.exp(lam * x))


def test_mixing_rates_equal_a_dense_solver(spark, given):
    rows = mixing.mixture(given).collect()
    differ = 0
    for s in {r.source for r in rows}:
        mine = [r for r in rows if r.source == s and r.size]
        sizes, rate = np.array([r.size for r in mine], float), np.array([r.rate for r in mine])
        if mine[0].target < 3 * mine[0].source_size * (1 - 1e-6):
            assert np.allclose(rate, _dense_rates(sizes, mine[0].target, 3), atol=1e-5)
            differ += len(set(rate.round(6))) > len(set(sizes)) / 2
        else:
            assert (rate == 3).all()
        assert abs((sizes * rate).sum() - mine[0].target) <= 1e-5 * mine[0].target
        assert sum(abs(r.copies - r.rate) > 1 for r in mine) <= 4  # those that close what rounding left
    assert differ > 5


def test_mixing_with_a_tilt_meets_the_targets(spark, given):
    got = mixing.mixture(given, tilt=1 + F.log(F.col("size") + 1) / 10).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("w"), F.max("size").alias("m")).collect()
    assert all(abs(r.t - r.w) <= r.m / 2 + 1 for r in got)


def test_targets_of_many_sources(spark):
    rng = np.random.default_rng(11)
    sizes = {f"s{k:04}": int(v) for k, v in enumerate(rng.pareto(0.7, 300) * 100)} | {None: 50}
    table = spark.createDataFrame([(f"={s}" if s else "", s, v) for s, v in sizes.items()], "key string, source string, source_size long")
    got = {r.key: r.target for r in mixing.targets(table).collect()}
    weights = [(5, 2, 1)[k % 3] for k in range(301)]
    level = lambda x: sum(min(3 * v, x * w) for v, w in zip(sizes.values(), weights, strict=True))
    low, high = 0.0, 1e9
    for _ in range(200):
        low, high = ((low + high) / 2, high) if level((low + high) / 2) < sum(sizes.values()) else (low, (low + high) / 2)
    assert all(got[f"={s}" if s else ""] == pytest.approx(min(3 * v, low * w)) for (s, v), w in zip(sizes.items(), weights, strict=True))


def test_language_of_held_out_documents(spark, given):
    train, rest = given.where("doc_id % 2 = 0"), given.where("doc_id % 2 = 1 and n_chars > 200")
    languages, model = langid.fit(train, "text", "lang", "doc_id")
    got = langid.identify(rest, languages, model).collect()
    assert sum(r.language.lang == r.lang for r in got) >= 0.95 * len(got)


def test_language_evidence_and_edges(spark, given):
    languages, model = langid.fit(given, "text", "lang", "doc_id")
    rows = [(1, None, "fr", "a.example.de"), (2, "", None, None), (3, "12345 !!! ###", "en", "x"), (4, "in", "de", "h.example.de"), (5, "in", None, "h.example.de"), (5, "in", None, "h.example.de")] + [(100 + k, "der die und nicht ein", "de", "h.example.de") for k in range(30)]
    got = {r.doc_id: r for r in langid.identify(_docs(spark, rows), languages, model, declared="lang", host=F.col("source")).collect()}
    assert not got[1].language.accepted and not got[2].language.accepted and not got[3].language.accepted
    assert got[4].language.lang == "de" and got[5].language.lang == "de"  # declared language, suffix and host decide
    assert langid.identify(_docs(spark, rows).where("false"), languages, model).count() == 0


def _fused(rows, heard, languages):
    """Language and posterior of each row (id, declared, host), fused row by row from the texts' likelihoods."""
    names = [*languages, langid.UNKNOWN]
    k = len(names)

    def favour(name, p):
        return np.array([np.log(p if x == name else (1 - p) / (k - 1)) for x in names]) if name in languages else np.zeros(k)

    def soft(x):
        e = np.exp(x - x.max())
        return e / e.sum()

    by_host = defaultdict(lambda: np.zeros(k))
    for i, said, host in rows:
        if heard[i] is not None:
            by_host[host] += soft(np.array(heard[i]) + favour((said or "").split("-")[0].lower(), langid.DECLARED))
    corpus = sum(by_host.values()) + 1
    corpus /= corpus.sum()
    domain = lambda h: ".".join(h.split(".")[-2:]) if "." in h else ""
    smooth = lambda n, prior, w: (n + w * prior) / (n.sum() + w)
    out = {}
    for i, said, host in rows:
        above = smooth(sum(n for h, n in by_host.items() if domain(h) == domain(host)), corpus, langid.DOMAIN_WEIGHT) if domain(host) else corpus
        prior = smooth(by_host[host], above, langid.HOST_WEIGHT)
        terms = favour((said or "").split("-")[0].lower(), langid.DECLARED) + favour(langid.SUFFIXES.get(host.split(".")[-1]) if "." in host else None, 0.8) + np.log(prior)
        p = soft(terms + (np.array(heard[i]) if heard[i] is not None else 0))
        out[i] = names[int(p.argmax())], p.max()
    return out


def test_fusion_equals_plain_python(spark, given):
    """Posteriors from the operator's own likelihoods, fused again row by row."""
    languages, model = langid.fit(given, "text", "lang", "doc_id")
    hosts = ["a.one.de", "b.one.de", "x.two.fr", "", "local"]
    rows = [(r.doc_id, r.text[:12], (None, "fr", "de-AT", "xx")[r.doc_id % 4], hosts[r.doc_id % 5]) for r in given.limit(60).collect()] + [(900, None, "fr", "a.one.de"), (901, "...", None, "x.two.fr")]
    docs = _docs(spark, rows)
    heard = {r.doc_id: r.ll for r in docs.select("doc_id", langid.likelihoods(docs, "text", model).alias("ll")).collect()}
    want = _fused([(i, said, host) for i, _, said, host in rows], heard, languages)
    got = {r.doc_id: r.language for r in langid.identify(docs, languages, model, declared="lang", host=F.col("source")).collect()}
    for i, (lang, posterior) in want.items():
        assert got[i].posterior == pytest.approx(posterior) and got[i].lang == lang


def test_language_of_pages_equals_plain_python(spark, given):
    """The query's rows over all given pages: declared language and host taken from page and address by plain Python."""
    languages, model = langid.fit(given, "text", "lang", "doc_id")
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    texts = pages.select("page_id", warc.plain_text(F.col("html")).alias("text"))
    heard = {r.page_id: r.ll for r in texts.select("page_id", langid.likelihoods(texts, "text", model).alias("ll")).collect()}
    rows = []
    for r in pages.select("page_id", "url", "html").collect():
        tag = re.search(r"<html[^>]*\slang=\"?([A-Za-z-]+)", r.html or "", re.IGNORECASE)
        rows.append((r.page_id, tag[1] if tag else None, urlsplit(r.url or "").hostname or ""))
    want = _fused(rows, heard, languages)
    got = {r.page_id: r for r in queries.lang_pages(spark, DATA).collect()}
    assert got.keys() == want.keys()
    for i, (lang, posterior) in want.items():
        assert got[i].lang == lang and got[i].posterior == pytest.approx(posterior, abs=1e-6)
        assert got[i].kept == (heard[i] is not None and lang != langid.UNKNOWN and posterior >= 0.5)


def test_languages_of_a_table_with_clashing_names(spark, given):
    odd = given.withColumn("picked", F.lit(1)).withColumn("label", F.lit("x")).withColumn("row_id", F.lit(2)).withColumn("row", F.lit(3)).withColumn("ll", F.lit(4))
    languages, model = langid.fit(odd.withColumn("lang", F.when(F.col("doc_id") % 10 == 0, "unknown").otherwise(F.col("lang"))), "text", "lang", "doc_id")
    assert "unknown" not in languages
    assert langid.identify(odd, languages, model).where("language.lang = lang").count() >= 0.95 * given.count()


def _page(k, body):
    return f'<html><head><title>t{k}</title><script>var x = "<p>no</p>";</script></head><body><header>Site</header><nav><ul><li>Home<li>News</ul></nav><div class="cookie-notice">Accept</div>{body}<aside>Also</aside><div id="comments"><p>first!</p></div><form>mail<input></form><footer>&copy; me</footer></body></html>'


def test_main_text(spark):
    rows = [(k, "http://h.example/p", _page(k, f"<div><p>Read us daily</p><p>Story <b>num</b>ber {k} &amp; more<br>line{k}</p></div>")) for k in range(12)]
    rows += [(50, "http://a.example/", _page(50, "<article class=post><header><h1>Head</h1></header><p>One  two<p>Th&eacute;\nend &#8212;</article>")), (51, None, None), (52, "http://b.example", ""), (53, "x", "plain <i>te</i>xt <p>open"), (54, "http://c.example", "<p" + "x" * 50), (50, "http://a.example/", _page(50, "<article class=post><header><h1>Head</h1></header><p>One  two<p>Th&eacute;\nend &#8212;</article>"))]
    pages = spark.createDataFrame([(*r, "h", "s") for r in rows], "page_id long, url string, html string, host string, slots string")
    out = html.main_text(pages).collect()
    got = {r.page_id: r.text for r in out}
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    assert got[3] == "Story number 3 & more line3"  # the line on all pages is template
    assert got[50] == "Head One two Thé end —" and got[51] == got[52] == "" and got[53] == "plain text open"
    assert html.main_text(pages.where("false")).count() == 0


def test_template_of_a_host_with_odd_pages(spark):
    first = [r.id for r in spark.range(12).orderBy(F.xxhash64("id")).collect()]
    odd = {first[0]: "", first[1]: "<html><body><h1>Error 500</h1></body></html>"}
    for least in (first[0], first[1]):
        rows = [(k, "http://h.example/p", odd.get(k, f"<html><body><div><p>Read us daily</p><p>Story number {k} of its own words</p></div></body></html>")) for k in range(12) if k == least or k not in odd]
        got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert all(t == f"Story number {k} of its own words" for k, t in got.items() if k not in odd)


def test_near_copies_lose_no_paragraph(spark):
    story = {k: [f"{f'new{k}' if i == k % 10 else 'old'} words of part {i} of one story" for i in range(10)] for k in range(40)}
    copies = [(k, "http://h.example/p", "<html><body><div>Menu</div><article><p>" + "</p><p>".join(parts) + "</p></article></body></html>") for k, parts in story.items()]
    others = [(100 + k, "http://h.example/p", f"<html><body><article><p>Read us daily</p><p>Story number {k} of its own words</p></article></body></html>") for k in range(10)]
    for rows in (copies, copies + others):
        got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert all(got[k] == " ".join(parts) for k, parts in story.items())
    assert all(got[100 + k] == f"Story number {k} of its own words" for k in range(10))


def _tree(rng, size):
    return [(-1, 0, "r")] + [(int(rng.integers(0, k)), 0, "ab"[int(rng.integers(0, 2))]) for k in range(1, size)]


def _score(a, b, i=0, j=0):
    """Simple tree matching as published: every order-preserving choice of children is tried."""
    if a[i][2] != b[j][2]:
        return 0
    x, y = ([k for k, n in enumerate(t) if n[0] == at] for t, at in ((a, i), (b, j)))
    most = min(len(x), len(y))
    return 1 + max(sum(_score(a, b, p, q) for p, q in zip(u, v)) for n in range(most + 1) for u in combinations(x, n) for v in combinations(y, n))


def test_tree_matching_equals_exhaustive_choice():
    rng = np.random.default_rng(7)
    for _ in range(300):
        a, b = _tree(rng, int(rng.integers(1, 9))), _tree(rng, int(rng.integers(1, 9)))
        score, at = html.matched(a, b)
        pairs = [(i, j) for i, j in enumerate(at) if j >= 0]
        assert score == _score(a, b) == len(pairs) == len({j for _, j in pairs})
        assert all(a[i][2] == b[j][2] and (not i or at[a[i][0]] == b[j][0]) for i, j in pairs)
        assert all(i < k and j < m for i, j in pairs for k, m in pairs if a[i][0] == a[k][0] and i < k)


def _texts(spark, rows, **options):
    return {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), **options).collect()}


def test_varying_slots_decide_without_article_or_marks(spark):
    def page(k):
        links = "".join(f'<li><a href="/{k}{i}">place {k} {i}</a></li>' for i in range(20))
        return f'<html><body><div class="x1"><ul>{links}</ul></div><div class="x2">Small words {k}</div><div class="x3"><h2>Story {k}</h2>' + "".join(f"<p>Part {i} of the story number {k}, told at length.</p>" for i in range(1 + k % 4)) + "<p>Read us daily</p></div></body></html>"

    rows = [(k, "http://h.example/p", page(k)) for k in range(12)]
    want = {k: f"Story {k} " + " ".join(f"Part {i} of the story number {k}, told at length." for i in range(1 + k % 4)) for k in range(12)}
    assert _texts(spark, rows) == want
    off = _texts(spark, rows, template=False)
    assert all(off[k] != want[k] and "place" in off[k] and "Read us daily" in off[k] for k in want)


def test_varying_slots_overrule_marks_that_choose_wrongly(spark):
    body = '<html><body><article><h1>Site of the day</h1><p>Always the same.</p></article><div class="related"><h2>Tale {0}</h2><p>The tale {0} goes on for very many words of {0}.</p><p>And ends {0}.</p><div class="ad">Buy {0}</div></div><div class="comments"><p>{1}</p></div></body></html>'
    rows = [(k, "http://h.example/p", body.format(f"n{k}", f"reader {k} says much about it " * 9)) for k in range(8)]
    assert _texts(spark, rows) == {k: f"Tale n{k} The tale n{k} goes on for very many words of n{k}. And ends n{k}." for k in range(8)}
    assert _texts(spark, rows, template=False) == dict.fromkeys(range(8), "Site of the day Always the same.")


def test_names_that_only_hold_a_marking_word_are_content(spark):
    page = '<article><div class="social-science"><p>One</p></div><p id="share-price-history">Two</p><div class="ad-box">No</div><div class="widget"><p>No</p></div><p class=it\'s>three</p><p>four it\'s</p><div id=comment-list>No</div><p>five</p></article>'
    assert _texts(spark, [(1, "http://a.example/", page)]) == {1: "One Two three four it's five"}


@pytest.mark.parametrize("page", ["<a " * 40_000, "<p class='x" * 20_000, '<p a="' * 20_001, "<!" * 40_000, "<!--" * 30_000, "<div>" * 3_000 + "deep" + "</p>" * 3_000, "<div>" * 30_000 + "x", "<script>" * 20_000, "<b" * 40_000, "<div><p>" * 3_000, "a < b <3 c"])
def test_hostile_pages_take_linear_time_and_no_recursion(page):
    from time import process_time

    began = process_time()
    layout, _ = html.layout_of(html.parse(page))
    assert html.matched(layout, html.unpacked(html.packed(layout)))[0] == len(layout)
    assert len(html.ruled(layout)) == len(layout) and process_time() - began < 2


def _record(headers, body):
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers) + b"\r\n" + body + b"\r\n\r\n"


def test_warc_files_keep_headers_digests_and_charsets(spark, tmp_path):
    import gzip

    latin = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n<p>caf\xe9 &#233; &eacute; &#x41;"
    meta = "<meta charset='windows-1251'><p>мир".encode("cp1251")
    odd = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=nonsense\r\n\r\n<p>\xc3\xa9"
    whole = lambda n, block, *more: _record([("WARC-Type", "response"), ("WARC-Record-ID", f"<urn:uuid:{n}>"), ("WARC-Target-URI", f"http://q/{n}"), ("WARC-Date", "d"), *more, ("Content-Length", len(block))], block)
    first = whole(1, latin, ("WARC-IP-Address", "10.0.0.1"), ("WARC-Payload-Digest", "sha1:ABC"))
    first += _record([("WARC-Type", "response"), ("Content-Length", "abc")], b"lost") + whole(2, b"HTTP/1.1 200 OK\r\n\r\n" + meta) + _record([("WARC-Type", "request"), ("Content-Length", 2)], b"hi")
    (tmp_path / "a.warc").write_bytes(first)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(whole(3, odd)) + gzip.compress(whole(4, latin)))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(whole(5, latin))[:-20])
    (tmp_path / "d.warc").write_bytes(whole(6, latin)[:-60])
    read = warc.read_warc(spark, str(tmp_path))
    rows = read.collect()
    assert sorted(r.error.split(":")[0] for r in rows if r.error) == ["Content-Length is no number", "block is cut short", "broken gzip stream"]
    assert len({r.page_id for r in rows}) == len(rows) == 7
    made = {(r.refers_to, r.record_type): r for r in warc.derivatives(read).collect()}
    text = {k[0][-2]: r.block for k, r in made.items() if k[1] == "conversion"}
    assert text == {"1": "café é é A", "2": "мир", "3": "é", "4": "café é é A"}
    one = made["<urn:uuid:1>", "metadata"]
    assert one.source_digest == "sha1:ABC" and "10.0.0.1" in one.block and '"WARC-Payload-Digest":"sha1:ABC"' in one.block
    assert made["<urn:uuid:4>", "metadata"].source_digest.startswith("sha256:")


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<title>T&amp;</title><p>One<p>Two <a href=\"/l\">&lt;x&gt;</a><script>no</script>", "z"), (2, None, None, "z"), (2, None, None, "z")], "page_id long, url string, html string, record_type string")
    rows = warc.derivatives(warc.page_responses(pages)).collect()
    assert len(rows) == 6
    text = next(r for r in rows if r.page_id == 1 and r.record_type == "conversion")
    assert text.block == "T&\nOne\nTwo <x>"
    assert text.block_digest == "sha256:" + hashlib.sha256(text.block.encode()).hexdigest() and text.content_length == len(text.block.encode())
    made = warc.derivatives(warc.page_responses(pages))
    records = [r.record for r in warc.serialized(made).collect()]
    (tmp_path / "x.warc").write_bytes("".join(records).encode())
    back = list(warc.records((tmp_path / "x.warc").read_bytes()))
    assert len(back) == 6 and {f["warc-refers-to"] for _, f, _, _ in back} == {r.refers_to for r in rows}
    assert sorted(b.decode() for _, _, b, _ in back) == sorted(r.block for r in rows)
    body = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n<p>hi"
    (tmp_path / "r.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Target-URI: http://q/\r\nWARC-Date: d\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n")
    read = warc.read_warc(spark, str(tmp_path / "r.warc"))
    got = {r.record_type: r for r in warc.derivatives(read).collect()}
    assert got["conversion"].block == "hi" and "X: y" in got["metadata"].block and got["metadata"].refers_to == "<urn:uuid:1>"


def test_suffix_keeps_words_pieced_together_from_shorter_repeats(spark):
    """A text of sentences that each occur elsewhere, but never in this order, stays; a true passage beside them goes."""
    sentences = [" ".join(f"s{k}w{j}longer" for j in range(12)) for k in range(10)]
    mosaic, passage = " ".join(sentences), " ".join(f"p{j}" for j in range(55))
    rows = [(1, mosaic), (2, f"a {passage} b"), (3, f"c {passage} d {passage[:60]}")] + [(10 + k, f"q{k} {x} r{k}") for k, x in enumerate(sentences)]
    got = {r.row.doc_id: (bytes(r.kept).decode(), r.n_spans, r.n_removed) for r in suffix.remove_repeats(_docs(spark, [(i, t, "en", "s") for i, t in rows]), length=101, words=51).collect()}
    assert got.pop(2) == ("ab", 1, len(passage) + 2) and got.pop(3) == (f"cd {passage[:60]}", 1, len(passage) + 2)
    assert all(t == dict(rows)[i] and (n, gone) == (0, 0) for i, (t, n, gone) in got.items())


@pytest.mark.parametrize("slab", [7, 1 << 16])
def test_suffix_words_equal_brute_force(spark, given, slab, monkeypatch):
    """Every window of six words that occurs again goes, and no word of any other."""
    monkeypatch.setattr(suffix, "_SLAB", slab)
    words, length = 6, 11
    base = [(r.doc_id, r.text) for r in given.where("n_chars < 2000").select("doc_id", "text").limit(60).collect()] + [(900, None), (901, ""), (902, "w" * 5000), (903, "a b c d e f"), (904, "a b c d e f")]
    texts = {i: (t or "").encode() for i, t in base}
    places = {i: [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for i, t in texts.items()}
    windows = {i: [t[places[i][k][0] : places[i][k + words - 1][1]] for k in range(len(places[i]) - words + 1)] for i, t in texts.items()}
    count = Counter(w for ws in windows.values() for w in ws)
    got = {r.row.doc_id: bytes(r.kept) for r in suffix.remove_repeats(_docs(spark, [(i, t, "en", "s") for i, t in base]), length=length, words=words).collect()}
    for i, t in texts.items():
        gone = {j for k, w in enumerate(windows[i]) if count[w] > 1 for j in range(k, k + words)}
        stay = [t[a:b] for j, (a, b) in enumerate(places[i]) if j not in gone]
        left = re.findall(rb"[^\x20\x09-\x0D]+", got[i])
        if not gone:
            assert got[i] == t
        else:  # what stays is whole but for the words that a run's edge cuts or joins
            assert sum(map(len, left)) <= sum(map(len, stay)) and not any(count[b] > 1 and b in got[i] for b in windows[i])
            assert set(stay) - set(left) <= {t[a:b] for j, (a, b) in enumerate(places[i]) if j not in gone and ({j - 1, j + 1} & gone)}
