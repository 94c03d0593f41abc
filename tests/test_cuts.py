"""Cuts and packing against plain versions that slice strings, and the cases their rules name."""

import random
import re
import time

import pytest

from mediatables.functions import cuts
from mediatables.operators import text as ops


MARKS = ("; ", ": ", " — ", " – ", ", ", " - ")


def _may_end(text, end, most):
    """Whether a part of ``text`` may end at ``end`` by a soft mark that lies in reach as a whole."""
    for mark in MARKS:
        head = end - len(mark.rstrip())
        if head > most // 4 and head + len(mark) <= most + 1 and text[head : head + len(mark)] == mark:
            return True
    return False


def _assert_parts(text, most):
    """Each part ends at the last place of the best kind there is: soft mark, else space, else the limit."""
    left = text
    for part in cuts.split_oversize(text, most):
        if len(left) <= most:
            assert part == left
            left = ""
            break
        every = range(1, most + 1)
        kinds = [e for e in every if _may_end(left, e, most)], [e for e in every if left[e] == " "], [most]
        end = max(next(k for k in kinds if k))
        assert part == left[:end].strip()
        left = left[end:].strip()
    assert left == ""


def _assert_groups(units, most):
    """Every border but the last is the allowed one nearest to the even size; the last is the most even one allowed."""
    groups = cuts.pack_balanced(units, most)
    assert " ".join(groups) == " ".join(units)
    ends, at = [], 0
    for group in groups:
        size = 0
        while size < len(group):
            size += len(units[at]) + (size > 0)
            at += 1
        ends.append(at)
    n, starts = len(units), [0, *ends]
    length = lambda a, b: len(" ".join(units[a:b]))
    even = -(-length(0, n) // max(1, -(-length(0, n) // most)))
    allowed = lambda a: [b for b in range(a + 1, n + 1) if b == a + 1 or length(a, b) <= most]
    nearest = lambda a: min(allowed(a), key=lambda b: (abs(length(a, b) - even), -b))
    for a, b in zip(starts[:-3], ends[:-2]):
        assert b == nearest(a)
    if len(groups) > 1:
        a, b = starts[-3], ends[-2]
        first = nearest(a)
        options = [k for k in range(a + 1, first + 1) if k == first or length(k, n) <= most]
        assert b == min(options, key=lambda k: (abs(length(a, k) - length(k, n)), -k))


def test_oversize_and_balance_keep_their_rules():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "bcd", "efghijk", " ", " ", ", ", "; ", ": ", " — ", " – ", " - ", ". "]) for _ in range(rng.randint(1, 60))).strip()
        most = rng.randint(4, 40)
        if text:
            _assert_parts(text, most)
        _assert_groups(["x" * rng.randint(1, most) for _ in range(rng.randint(1, 14))], most)
    assert cuts.pack_balanced([], 9) == [] and cuts.split_oversize("", 9) == []


def test_oversize_and_balance_examples():
    assert cuts.split_oversize("one two, three four five", 12) == ["one two,", "three four", "five"]
    assert cuts.split_oversize("a, bcdefghijklmnop", 8) == ["a,", "bcdefghi", "jklmnop"]
    assert cuts.split_oversize("alpha; beta: gamma — delta", 14) == ["alpha; beta:", "gamma — delta"]
    assert cuts.pack_balanced(["aaaa", "bbbb", "cccc", "d"], 14) == ["aaaa bbbb", "cccc d"]
    assert cuts.pack_balanced(["aaaaaaaa", "bb", "c"], 9) == ["aaaaaaaa", "bb c"]


def test_long_runs_take_linear_time():
    cases = [(f, text) for f in (cuts.sentences_narration, cuts.sentences_prose, cuts.clauses) for text in ("." * 200_000, "x" * 200_000 + ", y", "a." * 100_000 + "@, z", ".\")" * 70_000 + " A", "-" * 200_000, "。" * 200_000, "@" * 200_000 + ", b", "www." * 50_000 + ", c")]
    for f, text in cases:
        began = time.perf_counter()
        assert "".join(f(text)) == text
        assert time.perf_counter() - began < 2, (f, text[:9])


@pytest.mark.parametrize(
    ("token", "want"),
    [("http://x.y/z", True), ("(www.q.org", True), ("www.", False), ("www.q.", False), ("me@x.org", True), ("<me@x.org", True), ("@x.org", False), ("me@org", False), ("me@x.org.", False), ("a@b.c@d.e", True), ("é@d.e", False), ("FTP://a", True), ("plain", False), ("", False)],
)
def test_addresses_end_tokens(token, want):
    assert cuts._ends_in_address(token) is want
    assert bool(re.search(rf"(?:{cuts.PROTECTED[4:]})\Z", token, re.ASCII | re.I)) is want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Mr. Fox ran. He hid.", ["Mr. Fox ran. ", "He hid."]),
        ("See e.g. this. And that!", ["See e.g. this. ", "And that!"]),
        ("Well... yes. J. R. Smith came.", ["Well... yes. ", "J. R. Smith came."]),
        ('He said "Stop." Then left. no more.', ['He said "Stop." ', "Then left. no more."]),
        ("好。很好！ Fine", ["好。", "很好！ ", "Fine"]),
        ("One\x01 two. Three\x01.", ["One\x01 two. ", "Three\x01."]),
        ("", []),
    ],
)
def test_sentences(text, want):
    assert cuts.sentences_narration(text) == want


def test_clauses_keep_addresses_and_control_characters():
    assert cuts.clauses("a\x01, b - c (d) see http://x.y/z, www.q.org: e") == ["a\x01, ", "b - ", "c ", "(d) ", "see http://x.y/z, ", "www.q.org: ", "e"]
    assert cuts.clauses("mail me@x.org (now)") == ["mail me@x.org (now)"]


def test_packing_hands_long_pieces_down():
    assert cuts.chunks_narration("aaaa bbbb. " + "x" * 25 + " cc, dd.", 10) == ["aaaa bbbb.", "x" * 10, "x" * 10, "x" * 5, "cc,", "dd."]
    assert cuts.merged([["a", "b"], [], ["cc", "d" * 9]], 6) == [["a b cc"], [], ["d" * 9]]
    assert cuts.chunks_narration("short", 9) == ["short"]


def test_chunks_of_edge_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n\n "), (4, "x" * 700), (5, "One\x01 word. " * 60), (5, "One\x01 word. " * 60)], "doc_id long, text string")
    for dialect in ("narration", "prose"):
        got = ops.chunk_corpus(docs, dialect).collect()
        assert {r.doc_id for r in got} == {4, 5} and all(0 < r.char_count == len(r.text) <= 300 for r in got)
        assert sum(r.text.count("\x01") for r in got if r.doc_id == 5) == 120
    assert ops.chunk_audit(ops.chunk_corpus(docs.where("doc_id <> 5"), max_chars=120), docs.where("doc_id <> 5"), 120).count() == 0
    assert ops.chunk_corpus(docs.where("false")).count() == 0
