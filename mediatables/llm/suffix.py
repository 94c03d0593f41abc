"""Removal of long repeated byte strings by prefix doubling.

A byte goes when it lies in a string of ``length`` bytes that starts at another place
too, in the same text or another. Ranking all positions of a corpus by doubling
moves some sixteen bytes per text byte and round, so the ranks are taken in two
steps that give the same bytes:

* **Sampled ranks.** Of the ``length``-byte window at each position, the position of its
  smallest ``SEED``-byte rank (the last on ties) stands for it. Neighbouring windows
  share one, so a text has about one run of windows per 150 bytes. Two equal windows
  have equal seeds at the same offset: runs whose seed rank is unique in the corpus
  fall out, and runs that are equal as a whole settle together.
* **Doubling.** The runs that are left (those around the ends of a repeat) are sorted by
  seed rank, and each of their positions gets the rank of its ``2*SEED`` bytes from the
  pair of ranks ``SEED`` apart, then of ``4*SEED`` bytes, until it is unique or ``length`` is
  reached. Only one copy of each different run takes part.

A seed rank that very many different runs share is dealt out in salted groups of
``GROUP`` runs; positions that a group leaves open are matched across groups by a join
on their rank, so such a seed is no task's own load.

Strings count as equal if 128 bits agree: a whole run by the ranks of its seed and of itself,
a position by its doubled rank and a second fingerprint of other constants. Two different strings
of a corpus of n positions meet with probability below n*n / 2**128. Texts go by a number that
is written with them, so no two rows share one.

Null text counts as empty and stays. Texts shorter than ``length`` stay whole. Rows that
repeat both id and text are copies like any others; an empty table gives an empty table.
Further columns pass through in ``row`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import FIRST, SECOND, Rolling, bounded_batches, by_bytes, cut, drop_cut, encoded, mix

#: Bytes of a repeat, and of a seed rank: a quarter, so that two doublings reach it.
LENGTH = 400
SEED = 100
#: Most different runs of one seed rank that are ranked together.
GROUP = 20_000
_LOW = np.uint64((1 << 24) - 1)
#: Bytes that one round of the sampling looks at; below 2**24.
_PIECE = 1 << 18
#: Word windows that are hashed and handed on at a time.
_SLAB = 1 << 16


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least value of each window of ``width`` neighbours."""
    n = len(x)
    rows = -(-n // width)
    full = np.full(rows * width, np.iinfo(x.dtype).max, x.dtype)
    full[:n] = x
    full = full.reshape(rows, width)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, seed: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one sampled seed: text number, first and last window, seed rank, rank of the run."""
    none = tuple(np.empty(0, np.int64) for _ in range(5))
    if len(data) < length:
        return none
    rolling = Rolling(data)
    rank = rolling.windows(seed)
    least = sliding_min((rank & ~_LOW) | (_LOW - np.arange(len(rank), dtype=np.uint64)), length - seed + 1)
    at = (_LOW - (least & _LOW)).astype(np.int64)
    mark = np.zeros(len(data) + 1, np.int8)
    long = ends - starts >= length
    np.add.at(mark, starts[long], 1)
    np.add.at(mark, ends[long] - length + 1, -1)
    place = np.flatnonzero(np.cumsum(mark)[: len(at)])
    if not len(place):
        return none
    own = at[place]
    new = np.concatenate(([True], (own[1:] != own[:-1]) | (place[1:] != place[:-1] + 1)))
    lo = place[new]
    hi = place[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(place) - 1]))]
    doc = np.searchsorted(starts, lo, side="right") - 1
    return doc, lo, hi, rank[own[new]].view(np.int64), rolling.spans(lo, hi + length).view(np.int64)


def _pieces(text: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """A very long text in overlapping pieces: each window lies in one of them alone."""
    for at in range(0, max(1, len(text) - length + 1), _PIECE):
        yield at, text[at : at + _PIECE + length - 1]


def _sampled(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            names = batch.schema.names
            texts = encoded(batch.column(names.index("text")).to_pylist())
            for a, b in by_bytes(texts, _PIECE):
                parts = [(i, at, piece) for i, t in enumerate(texts[a:b]) for at, piece in _pieces(t, length)]
                found = []
                for c, d in by_bytes([p for _, _, p in parts], _PIECE):
                    some = parts[c:d]
                    ends = np.cumsum([len(p) for _, _, p in some])
                    starts = ends - [len(p) for _, _, p in some]
                    part, lo, hi, rank, key = runs_of(np.frombuffer(b"".join(p for _, _, p in some), np.uint8), starts, ends, length, seed)
                    offset = np.array([at for _, at, _ in some])[part] - starts[part] if len(part) else part
                    found.append((np.array([i for i, _, _ in some])[part] if len(part) else part, lo + offset, hi + offset, rank, key))
                doc, lo, hi, rank, key = (np.concatenate(x) for x in zip(*found, strict=True))
                offsets = pa.array(np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32))
                rows = batch.slice(a, b - a)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (lo.astype(np.int64), hi.astype(np.int64), rank.astype(np.int64), key.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([rows.column(names.index("row")), pa.array([pack.compress(t) for t in texts[a:b]], pa.binary()), *lists], ["row", "ztext", "lo", "hi", "rank", "key"])

    return run


def _strings(length: int):
    """The bytes of the listed runs of each text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for uid, packed, runs in zip(batch["uid"], batch["ztext"], batch["runs"], strict=True):
                text = unpack.decompress(packed)
                yield pd.DataFrame([(r["rank"], r["salt"], r["salts"], r["open"], uid, r["lo"], text[r["lo"] : r["hi"] + length]) for r in runs], columns=["rank", "salt", "salts", "open", "uid", "lo", "bytes"])

    return run


def doubled(rank: np.ndarray, apart: int) -> np.ndarray:
    """Ranks of strings twice as long, from pairs of ranks ``apart``."""
    return mix(rank[:-apart] * np.uint64(0x9FB21C651E98DF25) + rank[apart:] * np.uint64(0xC2B2AE3D27D4EB4F))


def met(*names: np.ndarray) -> np.ndarray:
    """Which entries another one equals in all names."""
    order = np.lexsort(names)
    equal = np.ones(max(0, len(order) - 1), bool)
    for name in names:
        equal &= name[order][1:] == name[order][:-1]
    out = np.zeros(len(order), bool)
    out[order[1:]] |= equal
    out[order[:-1]] |= equal
    return out


def _settled(length: int, seed: int):
    """Positions of runs that share a seed rank, reranked at growing lengths."""

    def settle(rows: list[tuple]) -> pd.DataFrame:
        sizes = np.array([len(r[6]) for r in rows])
        starts = np.cumsum(sizes) - sizes
        windows = sizes - length + 1
        run = np.repeat(np.arange(len(rows)), windows)
        inside = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
        place = starts[run] + inside
        data = np.frombuffer(b"".join(r[6] for r in rows), np.uint8)
        rank, size = Rolling(data).windows(seed), seed
        shared = np.ones(len(place), bool)
        while size < length:
            step = min(size, length - size)
            rank, size = doubled(rank, step), size + step
            # a shorter string that no other position has can't grow into a shared one
            kept = np.flatnonzero(shared)
            if size < length:
                shared[kept] = met(rank[place[kept]])
        # past the last doubling a second fingerprint must agree too
        other = Rolling(data, SECOND).windows(length)
        kept = np.flatnonzero(shared)
        shared[kept] = met(rank[place[kept]], other[place[kept]])
        open_, salts = np.array([r[3] for r in rows]), np.array([r[2] for r in rows])
        uid, lo = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
        hit = np.flatnonzero(shared & open_[run])
        out = []
        if len(hit):
            new = np.concatenate(([True], (run[hit][1:] != run[hit][:-1]) | (inside[hit][1:] != inside[hit][:-1] + 1)))
            first = hit[new]
            last = hit[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(hit) - 1]))]
            out.append(pd.DataFrame({"uid": uid[run[first]], "s": lo[run[first]] + inside[first], "e": lo[run[last]] + inside[last] + length, "name": 0, "also": 0, "kind": 0}))
        many = salts[run] > 1
        if many.any():  # other groups of the same seed may hold what this one doesn't
            final, also = rank[place].view(np.int64), other[place].view(np.int64)
            lone = np.flatnonzero(~shared & many)
            own = open_[run[lone]]
            out.append(pd.DataFrame({"uid": uid[run[lone]], "s": lo[run[lone]] + inside[lone], "e": lo[run[lone]] + inside[lone] + length, "name": final[lone], "also": also[lone], "kind": np.where(own, 1, 2)}))
            both = np.flatnonzero(shared & many)
            out.append(pd.DataFrame({"uid": 0, "s": 0, "e": 0, "name": final[both], "also": also[both], "kind": 2}, index=range(len(both))).drop_duplicates())
        return pd.concat(out) if out else pd.DataFrame({k: [] for k in ("uid", "s", "e", "name", "also", "kind")}, dtype="int64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size, key = [], 0, None
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                if row[:2] != key and size > (1 << 19):
                    yield settle(held)
                    held, size = [], 0
                key = row[:2]
                held.append(row)
                size += len(row[6])
        if held:
            yield settle(held)

    return run


_SPACE = bytes((32, *range(9, 14)))


def whole_words(text: bytes, start: int, end: int) -> int:
    """Words that lie in a stretch as a whole, and not in part at its edges."""
    n = len(text[start:end].split())
    cut_first = n and start and text[start - 1] not in _SPACE and text[start] not in _SPACE
    cut_last = n and end < len(text) and text[end] not in _SPACE and text[end - 1] not in _SPACE
    return max(0, n - bool(cut_first) - bool(cut_last))


def merged(parts: list[dict] | None) -> list[list[int]]:
    """Stretches ``s, e``, sorted, as maximal runs."""
    runs: list[list[int]] = []
    for part in parts if parts is not None else ():
        if runs and part["s"] <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], part["e"])
        else:
            runs.append([part["s"], part["e"]])
    return runs


def word_windows(text: bytes, start: int, end: int, words: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Every ``words`` neighbouring whole words of a stretch: where they begin and end, and two hashes of their bytes.

    The first and the last window reach to the stretch's edges, beyond which no whole word lies.
    """
    if whole_words(text, start, end) < words:
        return
    piece = np.frombuffer(text[start:end], np.uint8)
    space = (piece == 32) | ((piece >= 9) & (piece <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    first, last = edge[::2], edge[1::2]
    i = int(start > 0 and not space[0] and text[start - 1] not in _SPACE)
    j = len(first) - int(end < len(text) and not space[-1] and text[end] not in _SPACE)
    for lo in range(i, j - words + 1, _SLAB):
        s = first[lo : min(lo + _SLAB, j - words + 1)]
        e = last[lo + words - 1 : lo + words - 1 + len(s)]
        some = piece[s[0] : e[-1]]
        names = [Rolling(some, k).spans(s - s[0], e - s[0]).view(np.int64) for k in (FIRST, SECOND)]
        a, b = s + start, e + start
        if lo == i:
            a[0] = start
        if lo + len(s) == j - words + 1:
            b[-1] = end
        yield a, b, *names


def _windowed(words: int):
    """The word windows of each text's runs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            held, n = [], 0
            for uid, packed, parts in zip(batch["uid"], batch["ztext"], batch["spans"], strict=True):
                text = unpack.decompress(packed)
                for start, end in merged(parts):
                    for a, b, name, also in word_windows(text, start, end, words):
                        held.append(pd.DataFrame({"uid": uid, "s": a, "e": b, "name": name, "also": also}))
                        n += len(a)
                        if n > _SLAB:
                            yield pd.concat(held)
                            held, n = [], 0
            if held:
                yield pd.concat(held)

    return run


def _confirmed(texts: DataFrame, spans: DataFrame, words: int) -> DataFrame:
    """Of the runs in ``spans`` (``uid, spans``) the parts where one passage of ``words`` words itself occurs again.

    A run may be pieced together from several shorter repeats; its words then occur nowhere else
    in a row. Every occurrence of a repeat lies in a run, so the runs' windows alone are counted.
    """
    windows = cut(texts.select("uid", "ztext").join(spans, "uid").mapInPandas(_windowed(words), "uid long, s long, e long, name long, also long"))
    again = cut(windows.groupBy("name", "also").count().where("count > 1").select("name", "also"))
    kept = cut(windows.join(again, ["name", "also"], "left_semi").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans")))
    drop_cut(windows, again, spans)
    return kept


def _removed():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            names = batch.schema.names
            packed, spans = batch.column(names.index("ztext")), batch.column(names.index("spans"))
            for at in range(0, len(batch), 256):
                kept, n, gone, count = [], [], [], []
                for z, parts in zip(packed.slice(at, 256), spans.slice(at, 256).to_pylist(), strict=True):
                    text, runs = unpack.decompress(z.as_py()), merged(parts)
                    edges = [0, *(x for r in runs for x in r), len(text)]
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                    n.append(len(text))
                    gone.append(len(text) - len(kept[-1]))
                    count.append(len(runs))
                yield pa.RecordBatch.from_arrays([batch.column(names.index("row")).slice(at, 256), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary())], ["row", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, group: int = GROUP, words: int = 0) -> DataFrame:
    """One row per input row: ``row`` (its columns but the text), ``n_bytes, n_removed, n_spans, kept``.

    ``kept`` holds the remaining bytes; ``n_spans`` counts maximal removed runs. With ``words`` only
    passages of so many whole words that occur again as such go, with what of a maximal run is left beyond its outer whole words.
    """
    bounded_batches(docs.sparkSession)
    seed = max(1, length // 4)
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    base = docs.select(F.col(f"`{text}`").cast("string").alias("text"), others.alias("row"))
    row_type = base.schema["row"].dataType.simpleString()
    sampled = base.mapInArrow(_sampled(length, seed), f"row {row_type}, ztext binary, lo array<long>, hi array<long>, rank array<long>, key array<long>")
    texts = cut(sampled.withColumn("uid", F.monotonically_increasing_id()))
    runs = texts.select("uid", F.inline(F.arrays_zip("lo", "hi", "rank", "key")))
    # ---- seeds that occur once fall out (counts are written, so that adaptive execution can split a hot seed's runs)
    seeds = cut(runs.groupBy("rank").agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).where("n > 1"))
    left = cut(runs.join(seeds, "rank").select("uid", "lo", "hi", "rank", "key", (F.col("a") == F.col("b")).alias("same")))
    # ---- runs that are equal as a whole settle together
    kinds = cut(left.where("not same").groupBy("rank", "key").agg(F.count("*").alias("n"), F.min(F.struct("uid", "lo", "hi")).alias("one")))
    spread = cut(kinds.groupBy("rank").agg(F.ceil(F.count("*") / group).cast("int").alias("salts")), tidy=False)
    settled = left.where("same").select("uid", "lo", "hi").union(left.where("not same").join(kinds.where("n > 1"), ["rank", "key"], "left_semi").select("uid", "lo", "hi"))
    settled = settled.select("uid", F.col("lo").alias("s"), (F.col("hi") + length).alias("e"))
    # ---- the others are ranked position by position
    work = kinds.join(spread, "rank").select("one.*", "rank", (F.col("n") == 1).alias("open"), "salts", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int").alias("salt"))
    lists = work.groupBy("uid").agg(F.collect_list(F.struct("rank", "salt", "salts", "open", "lo", "hi")).alias("runs"))
    strings = texts.select("uid", "ztext").join(lists, "uid").mapInPandas(_strings(length), "rank long, salt int, salts int, open boolean, uid long, lo long, bytes binary")
    strings = strings.repartition("rank", "salt").sortWithinPartitions("rank", "salt")
    found = cut(strings.mapInPandas(_settled(length, seed), "uid long, s long, e long, name long, also long, kind int"))
    across = cut(found.where("kind > 0").groupBy("name", "also").count().where("count > 1").select("name", "also"), tidy=False)
    again = found.where("kind = 1").join(across, ["name", "also"], "left_semi")
    spans = settled.union(found.where("kind = 0").select("uid", "s", "e")).union(again.select("uid", "s", "e"))
    spans = cut(spans.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans")))
    drop_cut(seeds, left, kinds, spread, found, across)
    if words:
        spans = _confirmed(texts, spans, words)
    joined = texts.select("uid", "row", "ztext").join(spans, "uid", "left").select("row", "ztext", "spans")
    return joined.mapInArrow(_removed(), f"row {row_type}, n_bytes long, n_removed long, n_spans long, kept binary")
