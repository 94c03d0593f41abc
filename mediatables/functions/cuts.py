"""Where a paragraph is cut: sentences, clauses, words, and pieces packed to a size.

Each function looks at one collapsed paragraph and is linear in its length. Columns of
paragraphs go through them in Arrow batches (see :mod:`.text`). A sentence or clause keeps the
space that follows it, so the pieces put together again are the paragraph.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate
from math import ceil

CLOSERS = "\"'’”)\\]}»›"
OPENERS = "\"'‘“(\\[{«‹"
#: Words that end in a dot without ending a sentence, narration dialect (fixed values; the
#: entries that end in a dot themselves can never match and are left out).
ABBREVIATIONS = tuple("mr mrs ms mx dr prof sr jr st messrs mme mlle rev hon capt lt sgt col gen vs etc e.g i.e cf viz ibid al esp u.s u.k u.s.a e.u a.m p.m p.s ph.d m.d b.a m.a b.sc m.sc fig figs vol vols chap pp inc ltd corp dept approx jan feb apr jun jul aug sep sept oct nov dec".split())
#: The same for the prose dialect (fixed values).
PROSE_ABBREVIATIONS = tuple("mr mrs ms dr prof sr jr st mt vs etc inc ltd co corp no fig approx dept est gen gov lt col sgt capt rev hon jan feb mar apr jun jul aug sep sept oct nov dec vol ch pp ed eds al e.g i.e u.s u.k a.m p.m ph.d b.a m.a".split())
#: Addresses and e-mails, which no cut may split (must match the corpora's rule: fixed value).
PROTECTED = r"(?i)(?:(?:https?|ftp|file)://|www\.)[^\s]*[^\s.,;:!?)\]}'\"]|[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+"

STOPS = ".!?…"
#: Each run of stops is tried once, from its head, and never given back in part.
_STOP, _WIDE_STOP = re.compile(rf"(?<![{STOPS}])[{STOPS}]++[{CLOSERS}]*+ "), re.compile(rf"[。！？][{CLOSERS}]*+ *+")
_PROSE_STOP = re.compile(rf"(?<![{STOPS}])[{STOPS}]++[\"'”’)\]]*+ ++")
_CLOSE, _PROSE_CLOSE = "\"'’”)]}»›", "\"'”’)]"
_OPEN, _PROSE_OPEN = "\"'‘“([{«‹", "\"'([“‘"
_SHORT, _PROSE_SHORT = frozenset(ABBREVIATIONS), frozenset(PROSE_ABBREVIATIONS)
#: How an address begins, what it can't end in, and the part of an e-mail address after the last "@".
_SCHEME, _NO_END = re.compile(r"(?:https?|ftp|file)://|www\.", re.I | re.ASCII), frozenset(".,;:!?)]}'\"")
_DOMAIN, _LOCAL = re.compile(r"[a-z0-9\-]+(?:\.[a-z0-9\-]+)+", re.I | re.ASCII), re.compile(r"[a-z0-9._%+\-]", re.I | re.ASCII)
_BREAK = re.compile(r"\s", re.ASCII)
_LONG_PART = re.compile(r"[^.]{3}", re.S)
#: Clause ends, stand-alone dashes and openers.
_CLAUSE = (re.compile(r"([,;:—–)\]}][\"'’”]*) "), re.compile(r"((?:^| )-+[\"'’”]*) "), re.compile(rf" (?=[{OPENERS}])"))
#: Where a sentence over the limit may end, best kinds alike (fixed values of the prose dialect).
_SOFT = re.compile("(?=(; |: | — | – |, | - ))")


def _kind(text: str) -> str:
    return unicodedata.category(text[0]) if text else ""


def _last_token(piece: str) -> str:
    return piece.rstrip(" ").rpartition(" ")[2]


def _cut_at(text: str, ends: list[int]) -> list[str]:
    places = sorted({0, len(text), *ends})
    return [text[a:b] for a, b in zip(places, places[1:])]


def _kept_apart(pieces: list[str], ends: Callable[[str, str], bool]) -> list[str]:
    """Neighbours as one wherever ``ends(left, right)`` does not hold."""
    groups: list[list[str]] = []
    for piece in pieces:
        if groups and not ends(groups[-1][-1], piece):
            groups[-1].append(piece)
        else:
            groups.append([piece])
    return ["".join(g) for g in groups]


def _stopped(token: str, closers: str) -> tuple[str, str]:
    """What stands before a token's last stops, and those stops ("" if it ends otherwise)."""
    token = token.rstrip(closers)
    word = token.rstrip(STOPS)
    return word, token[len(word) :]


def _narration_end(left: str, right: str) -> bool:
    token, run = _stopped(_last_token(left), _CLOSE)
    if not run:
        return True
    token = token.lstrip(_OPEN)
    if "…" in run or run.count(".") > 1:
        return False
    return run != "." or not (_kind(right) == "Ll" or token.lower() in _SHORT or len(token) == 1 and _kind(token) == "Lu")


def sentences_narration(paragraph: str) -> list[str]:
    return _kept_apart(_cut_at(paragraph, [m.end() for p in (_STOP, _WIDE_STOP) for m in p.finditer(paragraph)]), _narration_end)


def _prose_end(left: str, right: str) -> bool:
    token, run = _stopped(_last_token(left), _PROSE_CLOSE)
    word = (token if run else "").lower().strip(_PROSE_OPEN).rstrip(".")
    short = word in _PROSE_SHORT or len(word) == 1 and _kind(word)[0] == "L" or "." in word and not _LONG_PART.search(word)
    lower = _kind(right) == "Ll"
    return not (run == "." and (short or lower) or lower and (run[:1] == "…" or run[:1] == "." and len(run) > 1))


def sentences_prose(paragraph: str) -> list[str]:
    return _kept_apart(_cut_at(paragraph, [m.end() for m in _PROSE_STOP.finditer(paragraph)]), _prose_end)


def _ends_in_address(token: str) -> bool:
    """Whether a token ends in what ``PROTECTED`` matches: a web address, or an e-mail address."""
    scheme = _SCHEME.search(token)
    if scheme and token[-1] not in _NO_END:
        rest = token[scheme.end() :]
        if rest and not _BREAK.search(rest):
            return True
    local, at, domain = token.rpartition("@")
    return bool(at and local and _LOCAL.match(local[-1]) and _DOMAIN.fullmatch(domain))


def clauses(sentence: str) -> list[str]:
    """Pieces of a sentence between commas, dashes and brackets; none ends right after an address."""
    cut = next(c for c in map(chr, range(0xF0000, 0x10FFFE)) if c not in sentence)  # a character that the text lacks
    for pattern in _CLAUSE:
        sentence = pattern.sub(lambda m: f"{m[0]}{cut}", sentence)
    return _kept_apart([p for p in sentence.split(cut) if p], lambda left, right: not _ends_in_address(_last_token(left)))


def packed(pieces: list[str], most: int, split: Callable[[str], list[str]]) -> list[str]:
    """Neighbours put together while they fit; a longer piece is split and closes the run."""
    out, open_ = [], ""
    for piece in pieces:
        if len(piece.rstrip(" ")) > most:
            out += [open_.rstrip(" "), *split(piece)]
            open_ = ""
        elif open_ and len(open_) + len(piece.rstrip(" ")) <= most:
            open_ += piece
        else:
            out.append(open_.rstrip(" "))
            open_ = piece
    return [x for x in (*out, open_.rstrip(" ")) if x]


def hard_cuts(word: str, most: int) -> list[str]:
    word = word.rstrip(" ")
    return [word[k : k + most] for k in range(0, len(word), most)]


def pack_words(text: str, most: int) -> list[str]:
    words = re.findall("[^ ]+ *| +", text)
    return packed([w.rstrip(" ") + " " * (w[-1] == " ") for w in words], most, lambda w: hard_cuts(w, most))


def chunks_narration(paragraph: str, most: int) -> list[str]:
    """Chunks of at most ``most`` characters: sentences, else clauses, else words, else cuts."""
    if len(paragraph) <= most:
        return [paragraph]
    return packed(sentences_narration(paragraph), most, lambda s: packed(clauses(s.rstrip(" ")), most, lambda c: pack_words(c, most)))


def split_oversize(sentence: str, most: int) -> list[str]:
    """A sentence over ``most`` characters in parts.

    Each part ends at the last soft end that it reaches past a quarter of ``most``, else at the
    last space, else at ``most``. Soft ends and spaces are found once; the parts are looked
    up among them by bisection.
    """
    soft = [(m.start() + len(m[1]) - 1, m.start()) for m in _SOFT.finditer(sentence)]
    spaces = [m.start() for m in re.finditer(" ", sentence)]
    end, at, out = len(sentence), 0, []
    while end - at > most:
        k = bisect_right(soft, (at + most, end)) - 1
        stop = soft[k][0] if k >= 0 and soft[k][1] - at > most // 4 else 0
        if not stop:
            k = bisect_right(spaces, at + most) - 1
            stop = spaces[k] if k >= 0 and spaces[k] > at else at + most
        out.append(sentence[at:stop].strip())
        while stop < end and sentence[stop].isspace():
            stop += 1
        at = stop
    return [x for x in (*out, sentence[at:end].strip()) if x]


def pack_balanced(units: list[str], most: int) -> list[str]:
    """Units joined by spaces into groups of near even size.

    The even size is the total over the fewest groups that could hold it. A group ends at the
    unit whose end lies nearest to it (the later on ties), within ``most``. At last the border of the
    two last groups moves back while that evens their sizes. Sizes are differences of running sums.
    """
    if not units:
        return []
    upto = [0, *accumulate(len(u) + 1 for u in units)]
    size = lambda a, b: upto[b] - upto[a] - 1
    n, whole = len(units), size(0, len(units))
    even, borders = ceil(whole / max(1, ceil(whole / most))), [0]
    while borders[-1] < n:
        a = borders[-1]
        b = max(a + 1, bisect_right(upto, upto[a] + 1 + even) - 1)
        if b < n and size(a, b + 1) <= most and even - size(a, b) >= size(a, b + 1) - even:
            b += 1
        borders.append(b)
    if len(borders) > 2:
        a, b, _ = borders[-3:]
        gap = lambda k: abs(size(a, k) - size(k, n))
        while b - a > 1 and size(b - 1, n) <= most and gap(b - 1) < gap(b):
            b -= 1
        borders[-2] = b
    return [" ".join(units[a:b]) for a, b in zip(borders, borders[1:])]


def chunks_prose(paragraph: str, most: int) -> list[str]:
    if len(paragraph) <= most:
        return [paragraph]
    return pack_balanced([part for s in sentences_prose(paragraph) for part in split_oversize(s.strip(), most)], most)


def merged(lists: list[list[str]], most: int) -> list[list[str]]:
    """Chunks of neighbouring paragraphs joined by a space while they fit; each stays with its first paragraph."""
    out: list[list[str]] = [[] for _ in lists]
    last = None
    for place, chunks in enumerate(lists):
        for chunk in chunks:
            if last is not None and len(out[last][-1]) + 1 + len(chunk) <= most:
                out[last][-1] += " " + chunk
            else:
                out[place].append(chunk)
                last = place
    return out
