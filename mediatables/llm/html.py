"""Main text of pages by wrapper induction.

Pages of one host share a template. Each page's tree of block elements is folded into its
layout (equal neighbours become one node). Per host a grouped count finds the commonest
``REFERENCES`` layouts, and every layout of the host is aligned with the
reference that simple tree matching scores best, so the same place of the template bears
the same node number on all pages. Layouts that are less than ``ALIKE`` like all of these are taken up in
further rounds, each with twice as many references from among them, until every layout that at least
``LEAST`` pages are alike to has been a reference or has one; a layout that fewer pages are alike to keeps the
best of the first. Per place the host's pages then tell:

* a text that most pages bear at one place is **template**, but for titles inside the content: the
  text of a heading, term, caption or table head that bears no mark, is not mostly links and
  has varying text in what it names (siblings up to the next heading of its rank or above, or the next term). A page whose text lies for the larger
  part in texts that its host's pages share (an exact copy, or one with a word or paragraph
  changed) counts for nothing here, so a host full of copies or near copies loses nothing;
* the other places are **varying slots**, and the host's sums of unlinked varying text decide
  which of them are content: from the root down to the container that holds most of it,
  less what is mostly links. Marks (tags, roles, classes that name menus, notices, adverts,
  comments ...) only break ties there: a marked container counts ``MARKED`` of its text, and
  inside the content a marked element goes if it holds less than half of the text.

Hosts with fewer than ``LEAST`` pages of other text, and hosts where no container holds most
text, use fixed rules alone: what lies in article or main if there is such, less what is marked.

Pages are parsed once, in one pass over their own partitions; the parsed texts are written and
everything after works on them. Tables a layout or a host are broadcast below a checked size;
beyond it Spark joins by sorting, where adaptive execution splits hot hosts. Counts are added
up per batch before they are shuffled. No step recurses; parsing is linear. Matching is exact: its time grows with the pairs of different
subtrees, and the further rounds' with the pairs of layouts of a host that are unlike; those are spread over tasks in
blocks of ``BLOCK`` references, and pairs that can't be alike by their labels alone are not matched.

Character references are decoded as HTML5 does, white space in a block becomes one space, and
blocks follow in page order with one space between. A tag that the page never closes ends it.
Null and empty pages give an empty text. Pages without a host form one host of their own. Rows
that repeat give equal rows; an empty table gives an empty table; only id, address and page are
read, whatever else the table holds.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .langid import host_of
from .shared import bounded_batches, cut, light

#: Elements that bear no content, elements whose inside is not markup, elements without an
#: inside, and inline elements, which neither end a block nor stand in the tree (fixed values).
DROPPED = frozenset("aside button canvas dialog footer form head iframe menu nav noscript object script select style svg template textarea title".split())
RAW = frozenset("script style textarea title noscript template svg iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: Elements of running text: a container with such children of its own is not divided further (fixed values).
FLOW = frozenset("#text p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure header".split())
#: Elements that name what follows them (fixed values).
TITLES = frozenset("h1 h2 h3 h4 h5 h6 dt caption th legend figcaption".split())
#: Opening one of these ends an open element of the set beside it (fixed values).
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}} | {t: {"p"} for t in "address article aside blockquote div dl footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()}
#: Words that mark what is no content, readers' comments, words that may stand beside them in a
#: class or id, and roles that mark (fixed values).
MARKS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies disclaimer footer gdpr hidden login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion related recommended search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split())
COMMENTS = frozenset("comment comments discussion disqus replies reply respond".split())
BESIDE = frozenset("area bar block body bottom box buttons container content div form global group header icons inner items left link links list main message nav news outer page panel post posts primary reader right row secondary section site slot strip text thread title to top unit user users wrap wrapper".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form navigation search".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: Attributes up to the tag's end: a quote counts only where a value begins.
_REST = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]++)?+)*+)>")
_ATTRIBUTE = re.compile(r"(?<![^\s/\"'])(class|id|role|hidden|aria-hidden)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|(?=[\s/]|\Z))", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
#: A text is template if at least this share of at least so many pages of other text bear it at one place.
SHARE, LEAST = 0.7, 4
#: A page is of other text if at least this share of its unlinked characters, or of those that the
#: fixed rules keep, is in no text that its host's pages share.
OWN = 0.5
#: References a host at first, the share of both layouts' nodes that must match for a layout to need no other, and
#: further references that a row holds.
REFERENCES, ALIKE, BLOCK = 3, 0.5, 8
#: What a marked container's text counts, the share of text that makes a container the content, and
#: the share in running text of its own (or a heading) that leaves a container whole.
MARKED, HEAVY, TEXT = 0.2, 0.5, 0.1
#: Counters that a task holds before it hands them on.
KEPT = 1 << 17
PLAIN, OFF, CORE, TALK = range(4)
#: Instead of a place: the row counts a slot, or pages.
SLOT, PAGE = -1, -2


class Page:
    """A page's tree, flat in page order: elements that are no inline ones, and text runs between such."""

    def __init__(self) -> None:
        self.label, self.parent, self.flag, self.text, self.linked = ["#root"], [-1], [PLAIN], [None], [0]

    def add(self, label: str, parent: int, flag: int, text: str | None = None, linked: int = 0) -> int:
        for column, value in ((self.label, label), (self.parent, parent), (self.flag, flag), (self.text, text), (self.linked, linked)):
            column.append(value)
        return len(self.label) - 1


def mark_of(value: str) -> int:
    """Whether a class or id has a name that marks what is no content.

    A name marks if all its words are marks or may stand beside one: ``ad-box`` does, ``social-science`` doesn't.
    """
    for name in value.split():
        words = [w.lower() for w in _WORD.findall(name)]
        if not COMMENTS.isdisjoint(words) and COMMENTS.union(BESIDE).issuperset(words):
            return TALK
        if not MARKS.isdisjoint(words) and MARKS.union(BESIDE).issuperset(words):
            return OFF
    return PLAIN


def _flagged(tag: str, attributes: str, inside_core: bool) -> tuple[str, int]:
    """The element's label (its tag and first class or id, without digits) and flag."""
    flag = OFF if tag in DROPPED or (tag == "header" and not inside_core) else CORE if tag in ("article", "main") else PLAIN
    name = ""
    if "=" in attributes or "hidden" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "role":
                flag = OFF if value.lower() in ROLES else CORE if value.lower() == "main" and flag == PLAIN else flag
            elif key in ("class", "id"):
                name = name or "-".join(_WORD.findall(value.split()[0]) if value.strip() else ())
                mark = mark_of(value)
                flag = TALK if TALK in (mark, flag) else mark or flag
            elif key == "hidden" or value.lower() == "true":
                flag = OFF
    return f"{tag}.{name}" if name else tag, flag


def parse(html: str) -> Page:
    """The tree of a page's block elements and text runs."""
    page = Page()
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, node, inside article or main
    open_: Counter = Counter()
    run: list[str] = []
    at, find, loose_off, anchor, linked = 0, html.find, [], False, 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = _SPACE.sub(" ", unescape("".join(run))).strip()
            run.clear()
            if text:
                page.add("#text", stack[-1][1], PLAIN, text, min(linked, len(text)))
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text and not loose_off:
            run.append(text)
            if anchor:
                linked += len(text)

    while True:
        start = find("<", at)
        if start < 0:
            say(html[at:])
            break
        close = html.startswith("/", start + 1)
        name = _NAME.match(html, start + 1 + close)
        if name is None:
            if html.startswith(("!", "?"), start + 1) or close:
                say(html[at:start])
                end = find("-->", start + 4) if html.startswith("!--", start + 1) else find(">", start)
                if end < 0:
                    break
                at = end + (3 if html.startswith("!--", start + 1) else 1)
            else:
                say(html[at : start + 1])
                at = start + 1
            continue
        say(html[at:start])
        rest = _REST.match(html, name.end())
        if rest is None:  # a quote that never closes: the tag ends at the first end there is
            end = find(">", name.end())
            if end < 0:
                break
            attributes, at = html[name.end() : end], end + 1
        else:
            attributes, at = rest[1], rest.end()
        tag = name[0].lower()
        if close:
            if loose_off and tag == loose_off[-1]:
                loose_off.pop()
            elif tag == "a":
                anchor = False
            elif tag not in INLINE and open_[tag]:
                flush()
                while stack[-1][0] != tag:
                    open_[stack.pop()[0]] -= 1
                open_[stack.pop()[0]] -= 1
                loose_off.clear()
                anchor = False
            continue
        alone = attributes.endswith("/")
        if tag in RAW:
            if not alone:
                end_ = _RAW_END[tag].search(html, at)
                at = end_.end() if end_ else len(html)
            continue
        if tag in VOID:
            say(" ")
            if tag == "hr":
                flush()
            continue
        label, flag = _flagged(tag, attributes, stack[-1][2])
        if tag in INLINE:
            if tag == "a":
                anchor = True
            if flag in (OFF, TALK) and not alone:
                loose_off.append(tag)
            continue
        flush()
        loose_off.clear()
        closes = CLOSES.get(tag, ())
        while len(stack) > 1 and stack[-1][0] in closes:
            open_[stack.pop()[0]] -= 1
        node = page.add(label, stack[-1][1], flag)
        if not alone:
            stack.append((tag, node, stack[-1][2] or flag == CORE))
            open_[tag] += 1
    flush()
    return page


# --------------------------------------------------------------------------- layouts and their alignment

#: A layout is a list of nodes (parent, flag, label); a parent stands before its children.
Layout = list[tuple[int, int, str]]


def _kids(parents: list[int]) -> list[list[int]]:
    kids: list[list[int]] = [[] for _ in parents]
    for i, p in enumerate(parents):
        if p >= 0:
            kids[p].append(i)
    return kids


def layout_of(page: Page) -> tuple[Layout, list[int]]:
    """The page's tree with equal neighbours folded into one, and each page node's place in it."""
    kids, shape, names = _kids(page.parent), [0] * len(page.label), {}
    for i in range(len(shape) - 1, -1, -1):
        row = [shape[k] for k in kids[i]]
        row = [s for k, s in enumerate(row) if not k or s != row[k - 1]]
        shape[i] = names.setdefault((page.label[i], page.flag[i], tuple(row)), len(names))
    layout, at, below = [(-1, PLAIN, "#root")], [0] * len(shape), {}
    for i, mine in enumerate(kids):
        place = -1
        for n, k in enumerate(mine):
            place += not n or shape[k] != shape[mine[n - 1]]
            known = below.get((at[i], place))
            if known is None:
                known = below[at[i], place] = len(layout)
                layout.append((at[i], page.flag[k], page.label[k]))
            at[k] = known
    return layout, at


def packed(layout: Layout) -> str:
    return "\n".join(f"{p} {f} {label}" for p, f, label in layout)


def unpacked(text: str) -> Layout:
    return [(int(p), int(f), label) for p, f, label in (line.split(" ", 2) for line in text.split("\n"))]


#: Pairs of children beyond which a match in order is tried first, and children beyond which rows are added up in arrays.
WIDE, SHORT = 1 << 16, 32
#: Children that a match in order skips at most for one of its label.
AHEAD = 16


def _in_order(x: list[int], y: list[int], la: list[str], lb: list[str], sa: list[int], sb: list[int]) -> list[tuple[int, int]]:
    """An order-preserving match of children, in nearly linear time.

    Subtrees that occur once on both sides and in the same order are anchors; between two anchors each child
    goes to the next free one of its label.
    """
    once = [{s: k for k, s in enumerate(shapes) if counts[s] == 1} for shapes in ([sa[i] for i in x], [sb[j] for j in y]) for counts in [Counter(shapes)]]
    both = sorted((k, once[1][s]) for s, k in once[0].items() if s in once[1])
    ends, back, at = [], [], []  # the longest run of anchors that rises on both sides
    for n, (_, q) in enumerate(both):
        k = bisect_left(ends, q)
        ends[k : k + 1] = [q]
        at[k : k + 1] = [n]
        back.append(at[k - 1] if k else -1)
    chain, n = [], at[-1] if at else -1
    while n >= 0:
        chain.append(both[n])
        n = back[n]
    out, p, q = [], 0, 0
    for p1, q1 in [*reversed(chain), (len(x), len(y))]:
        places = defaultdict(list)
        for k in range(q, q1):
            places[lb[y[k]]].append(k)
        for k in range(p, p1):
            free = places[la[x[k]]]
            j = bisect_left(free, q)
            if j < len(free) and free[j] - q <= AHEAD:
                out.append((x[k], y[free[j]]))
                q = free[j] + 1
        if p1 < len(x):
            out.append((x[p1], y[q1]))
        p, q = p1 + 1, q1 + 1
    return out


def _before(under, w):
    """Scores of the best matches that may use one more child, whose scores with the others are ``w``."""
    if isinstance(w, list):
        row = under[:]
        for q in range(len(w) - 1, -1, -1):
            row[q] = max(under[q], row[q + 1], under[q + 1] + w[q])
        return row
    row = np.empty_like(under)
    row[-1] = 0
    np.maximum.accumulate(np.maximum(under[:-1], under[1:] + w)[::-1], out=row[-2::-1])
    return row


def matched(a: Layout, b: Layout) -> tuple[int, list[int]]:
    """Simple tree matching: its score, and for each node of ``a`` its match in ``b`` (-1: none).

    Two nodes of one label score one more than the best order-preserving match of their
    children. Equal subtrees score their size; equal children at both ends match at once, as
    no other match of theirs scores more. A score depends on the two subtrees' shapes alone, so each pair of
    shapes is scored once, without recursion, and of a wide node's scores one row is held at a time (to find
    its matches, one more in each square root of its rows). Where the match in order takes up one side
    whole, none scores more. Time grows with the pairs of different subtrees, in the worst case with the product of both sizes.
    """
    la, lb = [label for *_, label in a], [label for *_, label in b]
    ka, kb, names, shapes, sizes = _kids([p for p, *_ in a]), _kids([p for p, *_ in b]), {}, [], []
    for tree, kids in ((a, ka), (b, kb)):
        shape, size = [0] * len(tree), [1] * len(tree)
        for i in range(len(tree) - 1, -1, -1):
            shape[i] = names.setdefault((tree[i][2], tuple(shape[k] for k in kids[i])), len(names))
            size[i] += sum(size[k] for k in kids[i])
        shapes.append(shape)
        sizes.append(size)
    (sa, sb), (za, zb), out = shapes, sizes, [-1] * len(a)
    if la[0] != lb[0]:
        return 0, out
    node_a, node_b = dict(zip(sa, range(len(a)))), dict(zip(sb, range(len(b))))
    alike, column = defaultdict(list), {}  # b's shapes by label, and each one's place among them
    for s, j in node_b.items():
        column[s] = len(alike[lb[j]])
        alike[lb[j]].append(s)
    scores: dict[int, np.ndarray] = {}

    def score(s: int) -> np.ndarray:
        """Scores of a shape of ``a`` with those of its label in ``b``; 0 as long as unknown."""
        if s not in scores:
            scores[s] = np.zeros(len(alike.get(la[node_a[s]], ())), np.int32)
            if s in column:
                scores[s][column[s]] = za[node_a[s]]
        return scores[s]

    def sides(i: int, j: int) -> tuple[list[tuple[int, int]], list[int], list[int]]:
        """Children that match at once, and the others."""
        x, y, lo = ka[i], kb[j], 0
        hx, hy = len(x), len(y)
        while lo < hx and lo < hy and sa[x[lo]] == sb[y[lo]]:
            lo += 1
        while hx > lo and hy > lo and sa[x[hx - 1]] == sb[y[hy - 1]]:
            hx, hy = hx - 1, hy - 1
        ends = list(zip(x[:lo], y[:lo])) + list(zip(x[hx:], y[hy:]))
        x, y = x[lo:hx], y[lo:hy]
        if len(x) * len(y) > WIDE:
            pairs = _in_order(x, y, la, lb, sa, sb)
            if all(sa[p] == sb[q] for p, q in pairs) and sum(za[p] for p, _ in pairs) == min(sum(za[p] for p in x), sum(zb[q] for q in y)):
                return ends + pairs, [], []
        return ends, x, y

    def weigher(y: list[int]):
        """How a child of ``a`` scores with each of ``y``."""
        at = defaultdict(list)
        for k, q in enumerate(y):
            at[lb[q]].append(k)
        columns = {label: np.array([column[sb[y[k]]] for k in ks]) for label, ks in at.items()}

        def weigh(p: int):
            w = np.zeros(len(y), np.int64)
            if la[p] in at:
                w[at[la[p]]] = score(sa[p])[columns[la[p]]]
            return w if len(y) > SHORT else w.tolist()

        return weigh

    def last(y: list[int]):
        return np.zeros(len(y) + 1, np.int64) if len(y) > SHORT else [0] * (len(y) + 1)

    todo = [] if sa[0] == sb[0] else [(sa[0], sb[0])]
    while todo:
        s, t = todo[-1]
        if score(s)[column[t]]:
            todo.pop()
            continue
        ends, x, y = sides(node_a[s], node_b[t])
        below: defaultdict = defaultdict(set)
        for q in y if x else ():
            below[lb[q]].add(sb[q])
        unknown = []
        for u in {sa[p] for p in x} if y else ():
            known = score(u)
            unknown += [(u, v) for v in below.get(la[node_a[u]], ()) if not known[column[v]]]
        if unknown:
            todo += unknown
            continue
        todo.pop()
        row, weigh = last(y), weigher(y)
        for p in reversed(x if y else ()):
            row = _before(row, weigh(p))
        score(s)[column[t]] = 1 + sum(za[p] for p, _ in ends) + int(row[0])
    pairs = [(0, 0)]
    while pairs:
        i, j = pairs.pop()
        out[i] = j
        if sa[i] == sb[j]:
            pairs += zip(ka[i], kb[j])
            continue
        ends, x, y = sides(i, j)
        pairs += ends
        if not x or not y:
            continue
        weigh, step, row, stops = weigher(y), isqrt(len(x)) + 1, last(y), {len(x): last(y)}
        for p in range(len(x) - 1, -1, -1):
            row = _before(row, weigh(x[p]))
            if p % step == 0:
                stops[p] = row
        p = q = 0
        while p < len(x) and q < len(y):
            end = min(len(x), (p // step + 1) * step)
            weights = [weigh(k) for k in x[p:end]]
            best = [stops[end]]
            for w in reversed(weights):
                best.append(_before(best[-1], w))
            best.reverse()
            first = p
            while p < end and q < len(y):
                here, under = best[p - first], best[p - first + 1]
                if la[x[p]] == lb[y[q]] and here[q] == under[q + 1] + weights[p - first][q]:
                    pairs.append((x[p], y[q]))
                    p, q = p + 1, q + 1
                elif here[q] == under[q]:
                    p += 1
                else:
                    q += 1
    return int(score(sa[0])[column[sb[0]]]), out


def ruled(layout: Layout) -> list[bool]:
    """Which nodes the fixed rules keep: what lies in an article or main (else anywhere), less what is marked."""
    off, core = [False] * len(layout), [False] * len(layout)
    for i, (p, flag, _) in enumerate(layout):
        off[i] = flag in (OFF, TALK) or (p >= 0 and off[p])
        core[i] = (flag == CORE and not off[i]) or (p >= 0 and core[p])
    return [not o and c for o, c in zip(off, core, strict=True)] if any(core) else [not o for o in off]


def _titles(kids: list[int], reference: Layout, free: list[int]) -> Iterator[int]:
    """The children that name varying text, from the last to the first."""
    told = dict.fromkeys((1, 2, 3, 4, 5, 6, 7, 8), False)  # by rank of heading; 7: terms, 8: others
    for k in reversed(kids):
        label = reference[k][2].split(".")[0]
        rank = int(label[1]) if re.fullmatch("h[1-6]", label) else 7 if label == "dt" else 8
        if label in TITLES:
            if told[rank]:
                yield k
            if rank < 8:  # it ends what titles of its rank or below name
                told.update({r: False for r in told if rank <= r < 7 or r == rank})
        if free[k] > 0:
            told.update({r: True for r in told if label not in TITLES or r < rank or r == 8})


def induced(reference: Layout, plain: dict[int, int], linked: dict[int, int]) -> list[int] | None:
    """Which nodes of a reference are content, from its host's sums of varying text; None where none stands out.

    0 is no content, 1 content where its text varies, 2 a title inside the content, whose text stays anyway.
    """
    kids = _kids([p for p, *_ in reference])
    free, tied = [plain.get(i, 0) for i in range(len(reference))], [linked.get(i, 0) for i in range(len(reference))]
    weight = {PLAIN: 1.0, CORE: 1.0, OFF: MARKED, TALK: 0.0}
    weighed = [float(f) if f >= t else 0.0 for f, t in zip(free, tied, strict=True)]
    for i in range(len(reference) - 1, 0, -1):
        parent, flag, _ = reference[i]
        weighed[i] *= weight[flag]
        for sums in (free, tied, weighed):
            sums[parent] += sums[i]
    here = 0
    while kids[here]:
        total = sum(weighed[k] for k in kids[here])
        flow = [k for k in kids[here] if reference[k][2].split(".")[0] in FLOW and reference[k][1] not in (OFF, TALK) and weighed[k]]
        if any(re.match("h[1-6]", reference[k][2]) for k in flow) or sum(weighed[k] for k in flow) > TEXT * total:
            break
        best = max(kids[here], key=weighed.__getitem__)
        if not total or weighed[best] < HEAVY * total:
            return None
        here = best
    if not free[here]:
        return None
    keep = [0] * len(reference)
    keep[here] = 1
    titles = {k for mine in kids for k in _titles(mine, reference, free)}
    for i in range(here + 1, len(reference)):
        p, flag, label = reference[i]
        if keep[p]:
            # what holds no text on any page says nothing of links
            stays = flag != TALK and (tied[i] <= free[i] or label == "#text") and not (flag == OFF and 2 * free[i] < free[here])
            title = flag not in (OFF, TALK) and (keep[p] == 2 or i in titles)
            keep[i] = int(stays) + int(stays and title)
    return keep


# --------------------------------------------------------------------------- the steps on Spark

_PARSED = "page_id long, url string, host string, layout long, shape string, nodes array<int>, texts array<string>, linked array<int>"


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for page_id, url, host, html in zip(batch["page_id"], batch["url"], batch["host"], batch["html"], strict=True):
            page = parse(html) if html else Page()
            layout, at = layout_of(page)
            shape = packed(layout)
            name = int.from_bytes(hashlib.blake2b(shape.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
            said = [i for i, t in enumerate(page.text) if t is not None]
            out.append((page_id, url, host, name, shape, [at[i] for i in said], [page.text[i] for i in said], [page.linked[i] for i in said]))
        yield pd.DataFrame(out, columns=["page_id", "url", "host", "layout", "shape", "nodes", "texts", "linked"])


def _aligned(floor: float | None = None):
    """Each layout's best reference, and every node's place in it; with ``floor`` each reference that is so much alike.

    A node without a match has the place of its nearest matched ancestor; ``state`` is 1 for such a node, 2 if it is marked.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, trees = [], {}
            for host, layout, n, shape, refs in zip(batch["host"], batch["layout"], batch["n"], batch["shape"], batch["refs"], strict=True):
                own, found = unpacked(shape), []
                labels = Counter(label for *_, label in own) if floor is not None else None
                for r in refs if refs is not None else ():
                    if r["shape"] not in trees:
                        other = unpacked(r["shape"])
                        trees[r["shape"]] = other, Counter(label for *_, label in other)
                    other, theirs = trees[r["shape"]]
                    nodes = len(own) + len(other)
                    if floor is not None and 2 * (labels & theirs).total() < floor * nodes:
                        continue
                    score, at = matched(own, other)
                    found.append((2 * score / nodes, -r["ref"], at))
                if floor is not None:
                    found = [x for x in found if x[0] >= floor]
                else:
                    found = [max(found, key=lambda x: x[:2])] if found else [(-1.0, 1, list(range(len(own))))]
                for alike, ref, at in found:
                    state = [0] * len(own)
                    for i, (p, flag, _) in enumerate(own):
                        if at[i] < 0:
                            at[i], state[i] = at[p], max(1, state[p], 2 * (flag in (OFF, TALK)))
                    out.append((host, layout, n, -ref, alike, at, state, ruled(own)))
            yield pd.DataFrame(out, columns=["host", "layout", "n", "ref", "alike", "at", "state", "ruled"])

    return run


_ALIGNED = "host string, layout long, n long, ref int, alike double, at array<int>, state array<int>, ruled array<boolean>"


def _commonest(layouts: DataFrame, most: int, taken: int) -> DataFrame:
    """The ``most`` commonest layouts of each host as references, numbered from ``taken``: ``host, layout, ref, shape``."""
    order = Window.partitionBy("host").orderBy(F.desc("n"), F.desc("layout"))
    ranked = layouts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return cut(ranked.select("host", "layout", (F.col("rank") - 1 + taken).alias("ref"), "shape"))


def _references(layouts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """References ``host, ref, shape``, and each layout with its own one and its nodes' places there."""
    says = F.contains("shape", F.lit("#text"))  # pages that say anything
    shown = F.struct("ref", "shape")
    refs = [_commonest(layouts.where(says), REFERENCES, 0)]
    lists = refs[0].groupBy("host").agg(F.sort_array(F.collect_list(shown)).alias("refs"))
    first = cut(layouts.join(light(lists), "host", "left").select("host", "layout", "n", "shape", "refs").mapInPandas(_aligned(), _ALIGNED))
    aligned, most, taken = [first], REFERENCES, REFERENCES
    pair = ["host", "layout"]
    left = layouts.where(says).join(first.where(F.col("alike") < ALIKE).select(*pair), pair, "left_semi")
    while True:
        # hosts with fewer pages left than a template takes have none to learn
        enough = left.groupBy("host").agg(F.sum("n").alias("pages")).where(F.col("pages") >= least).select("host")
        left = cut(left.join(enough, "host", "left_semi"))
        if left.isEmpty():
            break
        new = _commonest(left, most, taken)
        blocks = new.groupBy("host", F.floor(F.col("ref") / BLOCK).alias("block")).agg(F.collect_list(shown).alias("refs"))
        found = cut(left.join(blocks, "host").select("host", "layout", "n", "shape", "refs").mapInPandas(_aligned(ALIKE), _ALIGNED))
        useful = found.groupBy("host", "ref").agg(F.sum("n").alias("pages")).where(F.col("pages") >= least).select("host", "ref")
        best = F.max_by(F.struct("n", "ref", "alike", "at", "state", "ruled"), F.struct("alike", -F.col("ref")))
        chosen = cut(found.join(useful, ["host", "ref"], "left_semi").groupBy(*pair).agg(best.alias("x")).select(*pair, "x.*"))
        aligned.append(chosen)
        refs.append(new)
        # a reference that too few pages are alike to is done with as well
        left = left.join(chosen.select(*pair).union(new.select(*pair)).distinct(), pair, "left_anti")
        most, taken = 2 * most, taken + most
    if len(refs) == 1:
        return refs[0], first
    later = aligned[1]
    for part in aligned[2:]:
        later = later.union(part)
    every = refs[0]
    for part in refs[1:]:
        every = every.union(part)
    return every, cut(first.join(later.select(*pair), pair, "left_anti").union(later))


def _slots(ref: int, place: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Names of texts at places of a reference."""
    return (marks.astype(np.int64).view(np.uint64) + (place.astype(np.int64) + ((int(ref) + 2) << 32)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages a slot, a batch at a time, and unlinked and linked characters a place.

    ``common`` null: of all pages. Else of pages with much text in no slot of ``common``, whose text is not counted.
    """
    names = ["host", "ref", "place", "slot", "n", "plain", "linked"]
    for batch in batches:
        n: Counter = Counter()
        pages_: Counter = Counter()
        text: defaultdict = defaultdict(lambda: [0, 0])
        known: dict[tuple, np.ndarray] = {}

        def rows() -> pd.DataFrame:
            return pd.DataFrame([(h, r, SLOT, s, k, 0, 0) for (h, r, s), k in n.items()] + [(h, r, PAGE, 0, k, 0, 0) for (h, r), k in pages_.items()] + [(h, r, p, 0, 0, *x) for (h, r, p), x in text.items()], columns=names)

        for host, ref, at, by_rule, nodes, marks, chars, linked, common in zip(*(batch[c] for c in ("host", "ref", "at", "ruled", "nodes", "marks", "chars", "linked", "common")), strict=True):
            place = np.asarray(at)[nodes] if len(nodes) else np.empty(0, np.int64)
            slots = _slots(ref, place, np.asarray(marks, np.int64))
            if common is not None:
                if (host, ref) not in known:
                    known[host, ref] = np.asarray(common, np.int64)
                own = ~np.isin(slots, known[host, ref])
                tied = np.asarray(linked, np.int64)
                free = np.asarray(chars, np.int64) - tied
                ruled_ = np.where(np.asarray(by_rule)[nodes], free, 0)
                if not any(x.sum() and x[own].sum() >= OWN * x.sum() for x in (free, ruled_)):
                    continue
                for p, x, y in zip(place[own].tolist(), free[own].tolist(), tied[own].tolist(), strict=True):
                    sums = text[host, ref, p]
                    sums[0] += x
                    sums[1] += y
            n.update((host, ref, s) for s in set(slots.tolist()))
            pages_[host, ref] += 1
            if len(n) > KEPT:
                yield rows()
                n.clear()
                pages_.clear()
                text.clear()
        yield rows()


def _constant(counts: DataFrame, share: float, least: int) -> DataFrame:
    """Slots that at least ``share`` of the counted pages of a host and reference bear: ``host, ref, slots``."""
    of = counts.where(F.col("place") == PAGE).select("host", "ref", F.col("n").alias("of")).where(F.col("of") >= least)
    constant = counts.where(F.col("place") == SLOT).join(light(of), ["host", "ref"]).where(F.col("n") >= share * F.col("of"))
    return cut(constant.groupBy("host", "ref").agg(F.collect_list("slot").alias("slots")))  # no more than the slots of a page / share


def _wrapped(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The content nodes of each reference (null: the rules decide)."""
        for batch in batches:
            out = []
            for host, ref, shape, stats in zip(batch["host"], batch["ref"], batch["shape"], batch["stats"], strict=True):
                pages = sum(s["n"] for s in stats if s["place"] < 0)
                sums = [s for s in stats if s["place"] >= 0]
                keep = induced(unpacked(shape), {s["place"]: s["plain"] for s in sums}, {s["place"]: s["linked"] for s in sums}) if pages >= least else None
                out.append((host, ref, keep))
            yield pd.DataFrame(out, columns=["host", "ref", "keep"])

    return run


def _extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        known: dict[tuple, np.ndarray] = {}
        out = []
        for host, ref, at, state, by_rule, keep, nodes, marks, texts, chars, linked, slots in zip(*(batch[c] for c in ("host", "ref", "at", "state", "ruled", "keep", "nodes", "marks", "texts", "chars", "linked", "slots")), strict=True):
            if not len(texts):
                out.append("")
                continue
            nodes = np.asarray(nodes)
            place = np.asarray(at)[nodes]
            own = None if keep is None else np.asarray(keep)[place]
            kept = np.asarray(by_rule)[nodes] if own is None else (own > 0) & (np.asarray(state)[nodes] < 2)
            if slots is not None:
                if (host, ref) not in known:
                    known[host, ref] = np.asarray(slots, np.int64)
                varies = ~np.isin(_slots(ref, place, np.asarray(marks, np.int64)), known[host, ref])
                title = False if own is None else (own == 2) & (2 * np.asarray(linked) <= np.asarray(chars))
                kept = kept & (varies | title)
            out.append(" ".join(t for t, k in zip(texts, kept.tolist(), strict=True) if k))
        yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": out, "n_chars": [len(x) for x in out]})


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", share: float = SHARE, least: int = LEAST, template: bool = True) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars`` (code points). Without ``template`` the fixed rules decide alone."""
    bounded_batches(pages.sparkSession)
    base = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), host_of(F.coalesce(F.col(f"`{url}`"), F.lit(""))).alias("host"), F.col(f"`{html}`").alias("html"))
    parsed = base.mapInPandas(_parsed, _PARSED)
    parsed = cut(parsed.withColumn("marks", F.transform("texts", lambda t: F.xxhash64(t))).withColumn("chars", F.transform("texts", lambda t: F.length(t))))
    layouts = cut(parsed.groupBy("host", "layout").agg(F.count("*").alias("n"), F.min("shape").alias("shape")))
    refs, aligned = _references(layouts, least)
    aligned = aligned.select("host", "layout", "ref", "at", "state", "ruled")
    placed = parsed.join(light(aligned), ["host", "layout"])
    hosts = None
    if template:
        count, schema = placed.where("ref >= 0 and size(nodes) > 0").select("host", "ref", "at", "ruled", "nodes", "marks", "chars", "linked"), "host string, ref int, place int, slot long, n long, plain long, linked long"

        def added(rows: DataFrame) -> DataFrame:
            return cut(rows.mapInPandas(_counted, schema).groupBy("host", "ref", "place", "slot").agg(*[F.sum(c).alias(c) for c in ("n", "plain", "linked")]))

        common = _constant(added(count.withColumn("common", F.lit(None).cast("array<long>"))), share, 1)
        place = ["host", "ref"]
        counts = added(count.join(light(common.withColumnRenamed("slots", "common")), place, "left").withColumn("common", F.coalesce("common", F.array().cast("array<long>"))))
        templates = _constant(counts, share, least)
        stats = counts.where(F.col("place") != SLOT).groupBy(*place).agg(F.collect_list(F.struct("place", "n", "plain", "linked")).alias("stats"))  # a row a node of a reference
        keep = refs.join(stats, place).select("host", "ref", "shape", "stats").mapInPandas(_wrapped(least), "host string, ref int, keep array<tinyint>")
        hosts = cut(keep.join(templates, place, "left"))
    joined = placed.join(light(hosts), ["host", "ref"], "left") if hosts is not None else placed.withColumn("keep", F.lit(None).cast("array<tinyint>")).withColumn("slots", F.lit(None).cast("array<long>"))
    columns = ("page_id", "url", "host", "ref", "at", "state", "ruled", "keep", "nodes", "marks", "texts", "chars", "linked", "slots")
    return joined.select(*columns).mapInPandas(_extracted, "page_id long, url string, text string, n_chars long")
