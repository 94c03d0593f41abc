"""Near-duplicate texts: MinHash bands propose, odd sketches screen, full shingle sets decide.

One pass turns each text into a digest of its set of word shingles, ``BANDS`` band
keys of ``ROWS`` MinHash samples, and an odd sketch: a bitmap of ``BITS`` parities
into which all ``SAMPLES`` samples are folded. The XOR of two sketches has about
``BITS/2 * (1 - exp(-2*d/BITS))`` ones for ``d`` differing entries, which tells
high similarities apart well, so only likely pairs have their full sets compared.

Two documents of similarity 0.85 share a band with probability 1 - 8e-7 and one of
0.8 with 1 - 1e-4 (see ``reach``); a sketch of a pair at the threshold passes the screen
with a margin of about five standard deviations. Confirmed links are exact.

Groups of copies never become all their pairs. Texts with equal sets become one
class; each bucket first compares its members with its smallest class only (a star,
salted when it is large), and the components of what was confirmed are labelled.
Only buckets that still hold several labels are looked at again, in blocks of
bounded size: first by sketches alone, which leaves the members that have a likely partner of
another label; with the texts of those, a union-find inside the task skips pairs already
joined and returns a spanning forest. That second step is exhaustive over the remaining
cross-label pairs of a bucket, so no link is lost to the star.

A bucket too large for one block, as texts around one boilerplate make, is not compared in
pairs but split by its members' rarest samples: sets that agree in at least ``a`` of
``SAMPLES`` samples share one of their ``SAMPLES - a + 1`` first in any order that is common to all. Rare
ones first, the boilerplate's samples come last and bring nothing together. ``a`` leaves the
same margin as the sketches, so a pair at the threshold is lost with probability 7e-8
(see ``split_loss``); what the order is made of, a table of ``CELLS`` counts, has a fixed size.

Null and blank texts have an empty set and link with nothing. Rows that repeat a
``doc_id`` count as one document, and rows without one are left out. An empty table gives
an empty table. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Rolling, bounded_batches, by_bytes, components, cut, drop_cut, encoded, kept, mix

BANDS, ROWS, SAMPLES, BITS = 24, 5, 192, 512
#: Rows of a star or side of a block that one task compares.
BLOCK = 2_000
#: Counters of the table that tells rare samples from frequent ones.
CELLS = 1 << 20
#: What similarities may be estimated below their true value.
MARGIN = 0.15
_rng = np.random.default_rng(853)
_XOR = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_MUL = _rng.integers(0, 2**31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def reach(similarity: float) -> float:
    """The probability that two sets of this similarity share a band."""
    return 1 - (1 - similarity**ROWS) ** BANDS


def first_samples(similarity: float) -> int:
    """How many first samples, in a common order, two sets of this similarity share one of."""
    return SAMPLES - max(1, math.ceil(SAMPLES * (similarity - MARGIN))) + 1


def split_loss(similarity: float) -> float:
    """The probability that two sets of this similarity agree in fewer samples than ``first_samples`` takes."""
    least = SAMPLES - first_samples(similarity) + 1
    return sum(math.comb(SAMPLES, k) * similarity**k * (1 - similarity) ** (SAMPLES - k) for k in range(least))


def shingle_sets(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """Each text's distinct word shingles as sorted 64-bit hashes, A-Z in lower case."""
    out: list[np.ndarray] = []
    for a, b in by_bytes(texts, 1 << 18):
        some = [t.lower() for t in texts[a:b]]
        data = np.frombuffer(b"\n".join(some) + b"\n", np.uint8)
        ends = np.cumsum([len(t) + 1 for t in some])
        space = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
        start, end = edge[::2], edge[1::2]
        w = Rolling(data).spans(start, end)
        upto = np.searchsorted(start, ends)
        n = max(0, len(w) - words + 1)
        full = np.zeros(n, np.uint64)
        for j in range(words):
            full += w[j : j + n] * _STEP[j]
        full = mix(full)
        lo = 0
        for hi in upto:
            if hi - lo >= words:
                out.append(np.unique(full[lo : hi - words + 1]))
            elif hi > lo:
                out.append(mix(((w[lo:hi] * _STEP[8 : 8 + hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)).reshape(1)))
            else:
                out.append(np.empty(0, np.uint64))
            lo = hi
    return out


def samples(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash samples, one row a set."""
    out = np.zeros((len(sets), SAMPLES), np.uint32)
    for i, s in enumerate(sets):
        if len(s):
            short = (s ^ (s >> np.uint64(32))).astype(np.uint32)[:, None]
            least = None
            for k in range(0, len(short), 512):
                got = ((short[k : k + 512] ^ _XOR) * _MUL).min(axis=0)
                least = got if least is None else np.minimum(least, got)
            out[i] = least
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    part = mins[:, : BANDS * ROWS].reshape(len(mins), BANDS, ROWS).astype(np.uint64)
    return mix((part * _STEP[16 : 16 + ROWS]).sum(axis=2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP[30]).view(np.int64)


def odd_sketches(mins: np.ndarray) -> np.ndarray:
    """Bitmaps of ``BITS`` parities as 64-bit words, one row a set."""
    at = (mix(mins.astype(np.uint64) * _STEP[31] + np.arange(SAMPLES, dtype=np.uint64) * _STEP[32]) % np.uint64(BITS)).astype(np.int64)
    flat = (at + np.arange(len(mins))[:, None] * BITS).ravel()
    odd = (np.bincount(flat, minlength=len(mins) * BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(mins), BITS), axis=1).view(np.uint64)


def sample_keys(mins: np.ndarray) -> np.ndarray:
    """A number for each sample and its place, one row a set."""
    return mix(mins.astype(np.uint64) * _STEP[33] + np.arange(1, SAMPLES + 1, dtype=np.uint64) * _STEP[34]).view(np.int64)


def most_ones(similarity: float) -> int:
    """The XOR count up to which a pair may have this similarity."""
    d = 2 * SAMPLES * (1 - similarity)
    return math.floor(BITS / 2 * (1 - math.exp(-2 * d / BITS)))


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union (sorted distinct arrays)."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= percent * (len(a) + len(b) - inter)


SKETCH = "doc_id long, n_shingles long, digest string, bands array<long>, sketch binary, ztext binary"


def _sketched(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = kept("minhash", None, lambda: zstandard.ZstdCompressor(level=1))
        for batch in batches:
            texts = encoded(batch["text"])
            ids = batch["doc_id"].to_numpy()
            for a, b in by_bytes(texts, 1 << 20):
                sets = shingle_sets(texts[a:b], words)
                mins = samples(sets)
                keys, odd = band_keys(mins), odd_sketches(mins)
                yield pd.DataFrame({
                    "doc_id": ids[a:b],
                    "n_shingles": [len(s) for s in sets],
                    "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() for s in sets],
                    "bands": [list(k) if len(s) else [] for k, s in zip(keys, sets, strict=True)],
                    "sketch": [o.tobytes() for o in odd],
                    "ztext": [pack.compress(t) for t in texts[a:b]],
                })

    return run


class _Sets:
    """Shingle sets of packed texts; the most recent stay."""

    def __init__(self, words: int, most: int = 4096) -> None:
        self.words, self.most, self.kept, self.unpack = words, most, {}, zstandard.ZstdDecompressor()

    def of(self, doc: int, packed: bytes) -> np.ndarray:
        got = self.kept.get(doc)
        if got is None:
            if len(self.kept) >= self.most:
                self.kept.clear()
            got = self.kept[doc] = shingle_sets([self.unpack.decompress(packed)], self.words)[0]
        return got


def _stars(words: int, percent: int, ones: int):
    """Rows of one (leader, salt) stand together, the leader first; gives confirmed links."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack, key, lead, mark = zstandard.ZstdDecompressor(), None, None, None
        for batch in batches:
            u, v = [], []
            for leader, salt, doc, sketch, packed in zip(batch["leader"], batch["salt"], batch["doc_id"], batch["sketch"], batch["ztext"], strict=True):
                own = np.frombuffer(sketch, np.uint64)
                if leader == doc:
                    key, mark, lead = (leader, salt), own, shingle_sets([unpack.decompress(packed)], words)[0]
                elif key == (leader, salt) and np.bitwise_count(own ^ mark).sum() <= ones and alike(lead, shingle_sets([unpack.decompress(packed)], words)[0], percent):
                    u.append(doc)
                    v.append(leader)
            yield pd.DataFrame({"u": u, "v": v}, dtype="int64")

    return run


def _here(bands: np.ndarray, i: int, there: np.ndarray, key: int, band: int) -> np.ndarray:
    """Which members are to be compared with ``i`` in this group: the first band, or least of the first samples, that both share."""
    if band >= 0:
        return (bands[there] == bands[i]).argmax(axis=1) == band
    return bands[there, np.isin(bands[there], bands[i]).argmax(axis=1)] == key


def _near(ids: np.ndarray, label: np.ndarray, part: np.ndarray, sketch: np.ndarray, bands: np.ndarray, key: tuple, ones: int) -> Iterator[tuple[int, np.ndarray]]:
    """Members of one side of a block, each with those of the other that bear another label and a near sketch.

    The nearest come first; a pair is looked at in the first group that it shares.
    """
    of, band, left, right = (int(x) for x in key)
    columns = np.flatnonzero(part == right)
    for i in np.flatnonzero(part == left):
        there = columns[columns > i] if left == right else columns
        there = there[label[there] != label[i]]
        if len(there):
            count = np.bitwise_count(sketch[there] ^ sketch[i]).sum(axis=1)
            there, count = there[count <= ones], count[count <= ones]
            there = there[np.argsort(count, kind="stable")]
        if len(there):
            here = _here(bands, i, there, of, band)
            if here.any():
                yield i, there[here]


def _columns(block: pd.DataFrame) -> tuple[np.ndarray, ...]:
    sketch = np.frombuffer(b"".join(block["sketch"]), np.uint64).reshape(len(block), -1)
    return block["doc_id"].to_numpy(), block["label"].to_numpy(), block["part"].to_numpy(), sketch, np.stack([np.asarray(x) for x in block["bands"]])


BLOCK_KEY = ["key", "band", "lo", "hi"]


def _screened(ones: int):
    """Of blocks that stand together, the members that have a near sketch of another label; no texts needed."""

    def screen(block: pd.DataFrame) -> pd.DataFrame:
        seen = np.zeros(len(block), bool)
        for i, there in _near(*_columns(block), tuple(block[BLOCK_KEY].iloc[0]), ones):
            seen[i] = True
            seen[there] = True
        return block.loc[seen, [*BLOCK_KEY, "doc_id", "label", "part", "bands"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            keys = batch[BLOCK_KEY].to_numpy()
            if held and (held[-1][BLOCK_KEY].to_numpy()[-1] != keys[0]).any():
                yield screen(pd.concat(held, ignore_index=True))
                held = []
            ends = [*(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(batch)]
            start = 0
            for end in ends:
                held.append(batch.iloc[start:end])
                if end < len(batch):
                    yield screen(pd.concat(held, ignore_index=True))
                    held = []
                start = end
        if held:
            yield screen(pd.concat(held, ignore_index=True))

    return run


def _blocks(words: int, percent: int, ones: int):
    """One block of a bucket: a forest of the confirmed links between its labels."""

    def run(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        ids, label, part, sketch, bands = _columns(block)
        packed, sets = block["ztext"].to_numpy(), _Sets(words)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        u, v = [], []
        for i, there in _near(ids, label, part, sketch, bands, key, ones):
            for j in there:
                a, b = find(label[i]), find(label[j])
                if a != b and alike(sets.of(ids[i], packed[i]), sets.of(ids[j], packed[j]), percent):
                    root[max(a, b)] = min(a, b)
                    u.append(ids[i])
                    v.append(ids[j])
        return pd.DataFrame({"u": u, "v": v}, dtype="int64")

    return run


def _sampled(words: int):
    """All samples of each text, as bytes of 64-bit numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            keys = [sample_keys(samples(shingle_sets([unpack.decompress(t)], words)))[0].tobytes() for t in batch["ztext"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "sketch": batch["sketch"], "keys": keys})

    return run


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many samples fall into each cell."""
    n = np.zeros(CELLS, np.int64)
    for batch in batches:
        n += np.bincount(np.frombuffer(b"".join(batch["keys"]), np.int64) & (CELLS - 1), minlength=CELLS)
    at = np.flatnonzero(n)
    yield pd.DataFrame({"cell": at, "n": n[at]})


def _rarest(counts, most: int):
    """The ``most`` first samples of each set, rare cells first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = counts.value
        for batch in batches:
            out = []
            for packed in batch["keys"]:
                keys = np.frombuffer(packed, np.int64)
                out.append(np.sort(keys[np.lexsort((keys, often[keys & (CELLS - 1)]))[:most]]))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "sketch": batch["sketch"], "bands": out})

    return run


def _split(large: DataFrame, needed: DataFrame, words: int, percent: int, block: int) -> tuple[DataFrame, list[DataFrame]]:
    """Members of large buckets in groups of one rare sample: rows for blocks, and the tables they are read from."""
    spark = large.sparkSession
    sampled = cut(large.join(needed.select("doc_id", "sketch", "ztext"), "doc_id").select("doc_id", "label", "sketch", "ztext").mapInPandas(_sampled(words), "doc_id long, label long, sketch binary, keys binary"))
    counts = np.zeros(CELLS, np.int64)
    rows = sampled.select("keys").mapInPandas(_counted, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()  # CELLS rows at most
    counts[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    shared = spark.sparkContext.broadcast(counts)
    rare = cut(sampled.mapInPandas(_rarest(shared, first_samples(percent / 100)), "doc_id long, label long, sketch binary, bands array<long>"))
    drop_cut(sampled)
    named = rare.select("doc_id", "label", F.explode("bands").alias("key"), F.lit(-1).alias("band"))
    return _placed(named, _open(named, block)).join(rare.select("doc_id", "bands", "sketch"), "doc_id"), [rare]


def _open(named: DataFrame, block: int) -> DataFrame:
    """Groups that hold several labels, with the number of parts that keep each near ``block`` rows."""
    groups = named.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("a"), F.max("label").alias("b"))
    return groups.where("a <> b").select("key", F.ceil(F.col("n") / block).cast("int").alias("parts"))


def _placed(named: DataFrame, open_keys: DataFrame) -> DataFrame:
    """Members of open groups in each of their blocks."""
    left = named.join(open_keys, "key").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    left = left.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return left.select("key", "band", "doc_id", "label", "part", F.least("part", "with").alias("lo"), F.greatest("part", "with").alias("hi"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    ``component_id`` is the smallest ``doc_id`` reachable over links of similarity
    ``percent`` / 100 or more; ``kept`` marks the document that bears it.
    """
    bounded_batches(docs.sparkSession)
    ones = most_ones(max(0.0, percent / 100 - MARGIN))
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).where("doc_id is not null")
    marks = cut(base.mapInPandas(_sketched(words), SKETCH))
    small = cut(marks.groupBy("doc_id").agg(F.min(F.struct("digest", "n_shingles")).alias("s")).select("doc_id", "s.*"))
    classes = cut(small.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("rep")))
    reps = cut(marks.join(classes, (marks.doc_id == classes.rep) & (marks.digest == classes.digest), "left_semi").select("doc_id", "bands", "sketch"))
    shared_keys = reps.select(F.explode("bands").alias("key")).groupBy("key").count().where("count > 1").select("key")
    member = reps.select("doc_id", F.posexplode("bands").alias("band", "key"))
    member = cut(member.join(shared_keys, "key"))
    # ---- stars: every member of a bucket with the bucket's smallest class
    lead = member.groupBy("key").agg(F.min("doc_id").alias("leader"))
    pairs = cut(member.join(lead, "key").where("doc_id <> leader").select("leader", "doc_id").distinct())
    salts = pairs.groupBy("leader").agg(F.ceil(F.count("*") / block).cast("int").alias("salts"))
    # only documents of a shared bucket are needed again
    wanted = reps.join(member.select("doc_id").distinct(), "doc_id", "left_semi")
    needed = cut(wanted.join(marks.select("doc_id", "ztext"), "doc_id").select("doc_id", "bands", "sketch", "ztext"))
    drop_cut(marks, reps)
    body = needed.select("doc_id", "sketch", "ztext")
    spokes = pairs.join(salts, "leader").select("leader", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int").alias("salt"), "doc_id")
    hubs = salts.select("leader", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("leader").alias("doc_id"))
    star = spokes.union(hubs).join(body, "doc_id")
    star = star.repartition("leader", "salt").sortWithinPartitions("leader", "salt", F.col("doc_id") != F.col("leader"), "doc_id")
    links = cut(star.select("leader", "salt", "doc_id", "sketch", "ztext").mapInPandas(_stars(words, percent, ones), "u long, v long"))
    labels = components(links)
    # ---- buckets that still hold several labels
    named = member.join(labels, member.doc_id == labels.node, "left").select("key", "band", "doc_id", F.coalesce("component", "doc_id").alias("label"))
    open_keys = cut(_open(named, block))
    rows = _placed(named, open_keys.where("parts = 1")).join(needed.select("doc_id", "bands", "sketch"), "doc_id")
    large = cut(named.join(open_keys.where("parts > 1"), "key", "left_semi").select("doc_id", "label").distinct())
    more_tables = [open_keys, large]
    if large.limit(1).count():
        split, tables = _split(large, needed, words, percent, block)
        rows, more_tables = rows.unionByName(split), more_tables + tables
    light_ = rows.repartition(*BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY)
    near = cut(light_.select(*BLOCK_KEY, "doc_id", "label", "part", "bands", "sketch").mapInPandas(_screened(ones), "key long, band int, lo int, hi int, doc_id long, label long, part int, bands array<long>"))
    more = near.join(needed.drop("bands"), "doc_id").groupBy(*BLOCK_KEY).applyInPandas(_blocks(words, percent, ones), "u long, v long")
    more = cut(more)
    drop_cut(needed, member, pairs, near, *more_tables)
    # labels of the first step and the links between them give the rest
    whole = components(links.union(more))
    drop_cut(links, labels, more)
    named_class = classes.join(whole, classes.rep == whole.node, "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = small.join(named_class, "digest", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
