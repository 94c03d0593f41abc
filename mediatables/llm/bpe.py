"""Byte-level BPE encoding and decoding with a segment tree over adjacent pairs.

The vocabulary file (a ``tokenizers`` JSON of a byte-level BPE) is read once, on the
driver, and broadcast: its size is that of the vocabulary, checked against
``MOST_ENTRIES``, and never that of the data. Each pre-token is merged by a segment tree
whose leaves hold the ranks of adjacent pairs: the root is the leftmost lowest-rank
pair, each merge updates three leaves in logarithmic time, and merging ends when the
root holds no pair. A very long pre-token thus costs n log n. Words of one size are merged
side by side, a tree each, in arrays with a row a word. Frequent pre-tokens are
kept in a memo of at most ``MEMO`` entries per worker, or those of one megabyte of text.

Text is never shuffled: encoding is one pass over the input's own partitions.
Null text counts as empty and has no ids. The strings of special tokens inside a text
become their ids, as the library does by default. Rows, repeated or not, are independent;
an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from struct import pack
from typing import TypeVar

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, kept

T = TypeVar("T")
#: Entries of a vocabulary that may be broadcast.
MOST_ENTRIES = 1_000_000
#: Pre-tokens whose ids a worker remembers.
MEMO = 100_000
#: Characters of texts that are encoded together, and words that are merged side by side.
TOGETHER, SIDE_BY_SIDE = 1 << 20, 8192
#: Bytes up to which words are merged side by side; longer ones are merged one at a time.
LONG = 64
_FAR = 1 << 62


@lru_cache(maxsize=1)
def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves; the others get code points from 256 on, in order.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """Tokens, ranked merges and the rules that cut a text, as one file states them."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, cutter = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or cutter["type"] != "ByteLevel" or spec.get("normalizer") or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError(f"{path} is no plain byte-level BPE")
        if len(model["vocab"]) > MOST_ENTRIES:
            raise ValueError(f"{path} has over {MOST_ENTRIES} entries")
        letters = byte_letters()
        self.prefix_space = bool(cutter.get("add_prefix_space"))
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.bytes_of = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in self.ids.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.letter_ids = [self.ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((self.ids[a], self.ids[b]), (rank, self.ids[a + b]))
        self.merged_ids = np.zeros(len(model["merges"]), np.int64)
        for rank, merged_id in self.merges.values():
            self.merged_ids[rank] = merged_id
        pairs = sorted((a << 32 | b, rank) for (a, b), (rank, _) in self.merges.items())
        self.pairs = np.array([pair for pair, _ in pairs] + [_FAR], np.int64)
        self.pair_ranks = np.array([rank for _, rank in pairs] + [_FAR], np.int64)
        self.byte_ids = np.array([*self.letter_ids, -1], np.int64)
        self.byte_ranks = self.ranks(np.repeat(self.byte_ids, 257), np.tile(self.byte_ids, 257))

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, ``_FAR`` where it is none (as with -1, which is no id)."""
        pair = (left << 32) + right
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.pair_ranks[at], _FAR)


#: How a byte-level pre-tokenizer cuts a text (fixed value, as published with the vocabulary).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def point_update(tree: list[int], at: int, value: int) -> None:
    """Set a leaf and the least of each node above it, as far as that changes."""
    tree[at] = value
    at >>= 1
    while at:
        left, right = tree[2 * at], tree[2 * at + 1]
        least = left if left < right else right
        if tree[at] == least:
            return
        tree[at] = least
        at >>= 1


def merged(parts: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge neighbours, always the leftmost pair of the lowest rank, until none is ranked.

    A binary segment tree, padded to a power of two, holds ``rank * n + place`` of each adjacent
    pair, so its root is the leftmost pair of the lowest rank. A merge updates three leaves:
    the pair before, the merged pair's own and that of the token that went.
    """
    n, get = len(parts), merges.get
    if n < 2:
        return list(parts)
    ids, after, before = list(parts), list(range(1, n + 1)), list(range(-1, n - 1))
    leaf = 1 << (n - 2).bit_length()
    tree = [_FAR] * (2 * leaf)
    for i, pair in enumerate(zip(ids, ids[1:])):
        if pair in merges:
            tree[leaf + i] = merges[pair][0] * n + i
    for k in range(leaf - 1, 0, -1):
        left, right = tree[2 * k], tree[2 * k + 1]
        tree[k] = left if left < right else right
    while (root := tree[1]) < _FAR:
        i = root % n
        j = after[i]
        ids[i], ids[j] = merges[ids[i], ids[j]][1], -1
        after[i] = k = after[j]
        if j < n - 1 and tree[leaf + j] < _FAR:
            point_update(tree, leaf + j, _FAR)
        found = None
        if k < n:
            before[k] = i
            found = get((ids[i], ids[k]))
        point_update(tree, leaf + i, found[0] * n + i if found else _FAR)
        h = before[i]
        if h >= 0:
            found = get((ids[h], ids[i]))
            value = found[0] * n + h if found else _FAR
            if tree[leaf + h] != value:
                point_update(tree, leaf + h, value)
    return [i for i in ids if i >= 0]


def merged_words(words: list[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """Ids of many words at once, packed as little-endian 32-bit integers.

    Words whose trees have the same number of leaves are merged side by side, each in its own tree;
    long ones, of which there are few, singly.
    """
    out = [b""] * len(words)
    classes: dict[int, list[int]] = {}
    for at, word in enumerate(words):
        if len(word) <= LONG:
            classes.setdefault(1 << (len(word) - 2).bit_length() if len(word) > 2 else 1, []).append(at)
        else:
            ids = merged([vocabulary.letter_ids[b] for b in word], vocabulary.merges)
            out[at] = pack(f"<{len(ids)}I", *ids)
    for leaves, places in classes.items():
        for at in range(0, len(places), SIDE_BY_SIDE):
            part = places[at : at + SIDE_BY_SIDE]
            for place, ids in zip(part, _side_by_side([words[i] for i in part], leaves, vocabulary)):
                out[place] = ids
    return out


def _side_by_side(words: list[bytes], leaves: int, v: Vocabulary) -> list[bytes]:
    """:func:`merged` for words of at most ``leaves + 1`` bytes, a row of each array per word.

    Every row has one more place and one more leaf than it needs; they stay empty and stand for
    the neighbour that the first and the last token lack.
    """
    n, wide, deep, bits = len(words), leaves + 2, 2 * leaves + 1, leaves.bit_length() - 1
    held = np.arange(wide) < np.fromiter(map(len, words), np.int64, n)[:, None]
    raw = np.full((n, wide), 256)
    raw[held] = np.frombuffer(b"".join(words), np.uint8)
    ids = np.where(held, v.byte_ids[raw], -1).ravel()
    after = np.tile(np.arange(1, wide + 1), n)
    before = np.tile(np.arange(-1, wide - 1), n)
    rows = np.full((n, deep), _FAR)
    first = v.byte_ranks[raw[:, :leaves] * 257 + raw[:, 1 : leaves + 1]]
    rows[:, leaves : 2 * leaves] = np.where(first < _FAR, (first << bits) + np.arange(leaves), _FAR)
    for k in range(leaves - 1, 0, -1):
        np.minimum(rows[:, 2 * k], rows[:, 2 * k + 1], out=rows[:, k])
    tree, live = rows.ravel(), np.arange(n)
    while True:
        root = tree[live * deep + 1]
        live, root = live[root < _FAR], root[root < _FAR]
        if not len(live):
            break
        row, i = live * wide, root & (leaves - 1)
        j = after[row + i]
        k = after[row + j]
        h = before[row + i]
        token = v.merged_ids[root >> bits]
        ids[row + i], ids[row + j], after[row + i], before[row + k] = token, -1, k, i
        mine, theirs = v.ranks(token, ids[row + k]), v.ranks(ids[row + h], token)
        node = leaves + np.concatenate([j, i, np.where(h < 0, leaves, h)])
        base = np.tile(live * deep, 3)
        tree[base + node] = np.concatenate([np.full(len(live), _FAR), np.where(mine < _FAR, (mine << bits) + i, _FAR), np.where(theirs < _FAR, (theirs << bits) + h, _FAR)])
        np.minimum(node, 2 * leaves - 1, out=node)
        for _ in range(bits):
            node >>= 1
            under = base + 2 * node
            tree[base + node] = np.minimum(tree[under], tree[under + 1])
    left = ids >= 0
    flat, ends = ids[left].astype("<u4").tobytes(), np.cumsum(left.reshape(n, wide).sum(1)) * 4
    return [flat[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]


class Memo:
    """What is known of pre-tokens, ``value`` of their packed ids: ``fixed`` and up to ``most`` others.

    When more come, all go but those of the texts at hand, among which are the frequent ones.
    """

    def __init__(self, vocabulary: Vocabulary, most: int, value: Callable[[bytes], T], fixed: dict[str, T] | None = None) -> None:
        self.vocabulary, self.most, self.value, self.fixed = vocabulary, most, value, fixed or {}
        self.known = dict(self.fixed)

    def learn(self, tokens: set[str]) -> dict[str, T]:
        """A table that has all of ``tokens``; those it lacked are merged."""
        new = list(tokens.difference(self.known))
        if len(self.known) + len(new) > self.most + len(self.fixed):
            self.known = self.fixed | {t: self.known[t] for t in tokens.intersection(self.known)}
        ids = merged_words([t.encode("utf-8", "surrogatepass") for t in new], self.vocabulary)
        self.known.update(zip(new, map(self.value, ids)))
        return self.known


def texts_together(texts: Iterable[str | None]) -> Iterator[list[str]]:
    """Texts in turn, as many at a time as hold about ``TOGETHER`` characters (a longer one alone); null as empty."""
    held, size = [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


class Encoder:
    """Ids of texts; one per worker."""

    def __init__(self, vocabulary: Vocabulary, memo: int = MEMO) -> None:
        self.v, self.memo = vocabulary, Memo(vocabulary, memo, bytes)
        self.find = regex.compile(PATTERN).findall
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else lambda text: [text]
        self.tokens = [vocabulary.bytes_of.get(i, b"") for i in range(max(vocabulary.bytes_of) + 1)]

    def pieces(self, text: str) -> list[tuple[int | None, list[str]]]:
        """Special ids and the pre-tokens between them."""
        out: list[tuple[int | None, list[str]]] = []
        for k, part in enumerate(self.split(text)):
            if k % 2:
                out.append((self.v.special[part], []))
            elif part:
                out.append((None, self.find(" " + part if self.v.prefix_space and not part[0].isspace() else part)))
        return out

    def packed(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        for held in texts_together(texts):
            cuts = [self.pieces(text) for text in held]
            ids = self.memo.learn(set().union(*[tokens for cut in cuts for _, tokens in cut])).__getitem__
            for cut in cuts:
                yield b"".join([pack("<I", special) if special is not None else b"".join(map(ids, tokens)) for special, tokens in cut])

    def encode(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        return (np.frombuffer(packed, "<u4") for packed in self.packed(texts))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist())).decode("utf-8", "replace")


def shared_vocabulary(spark: SparkSession, path: str):
    bounded_batches(spark)
    return spark.sparkContext.broadcast(Vocabulary(path))


def encoder_of(shared) -> Encoder:
    """The worker's encoder for a broadcast vocabulary, kept between batches and tasks."""
    return kept("encoder", shared.value, lambda: Encoder(shared.value))


def with_token_ids(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` with the ids of each text in an array column (replacing one of that name)."""
    shared = shared_vocabulary(docs.sparkSession, path)

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoder_of(shared)
        for batch in batches:
            yield pd.Series([ids.astype(np.int32) for ids in encoder.encode(batch)])

    return docs.withColumn(ids, encode(F.col(f"`{text}`").cast("string")))


def with_decoded_text(docs: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``docs`` with the text of each array of ids (null ids: null)."""
    shared = shared_vocabulary(docs.sparkSession, path)

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoder_of(shared)
        for batch in batches:
            yield pd.Series([None if x is None else encoder.decode(np.asarray(x)) for x in batch])

    return docs.withColumn(text, decode(F.col(f"`{ids}`")))


def encoded_and_checked(docs: DataFrame, path: str, text: str = "text", rows: int = 256) -> DataFrame:
    """``row`` (the columns but the text), ``token_ids``, ``round_trip``: encoded and decoded again in one worker.

    Ids leave the task ``rows`` texts at a time, so that a worker holds few of them.
    """
    shared = shared_vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared)
        for batch in batches:
            for at in range(0, len(batch), rows):
                part = batch.slice(at, rows)
                ids = list(encoder.encode(t.as_py() for t in part.column(1)))
                same = [encoder.decode(i) == (t.as_py() or "") for i, t in zip(ids, part.column(1))]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(same, pa.bool_())], ["row", "token_ids", "round_trip"])

    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row")
    base = docs.select(others, F.col(f"`{text}`").cast("string").alias("text"))
    return base.mapInArrow(run, f"row {base.schema['row'].dataType.simpleString()}, token_ids array<int>, round_trip boolean")


def round_trip(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Encode and decode each text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    The same encoder and decoder as above in one pass, so that ids need not leave the task.
    """
    shared = shared_vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared)
        for batch in batches:
            count, left, right = [], [], []
            for packed in encoder.packed(t.as_py() for t in batch.column(1)):
                ids = np.frombuffer(packed, "<u4")
                count.append(len(ids))
                left.append(hashlib.sha256(packed).hexdigest())
                right.append(hashlib.sha256(encoder.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(left, pa.string()), pa.array(right, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
