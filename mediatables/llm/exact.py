"""Exact de-duplication by owners in Patricia tries.

A key is the hash of a text's bytes, their length, and the bytes themselves, whole. A
:class:`Trie` holds keys on compressed edges; what ends at a node is its terminal: the
smallest owner seen there, a count, and the numbers of what was merged. Two texts share a
terminal only if every byte agrees, however their hashes fall.

* **In the tasks that read the table** each row goes into the task's own trie. Every row gets the
  number of the first equal row that the trie knows (its ``rep``), and every terminal becomes one
  row, so a group of copies that holds a third of the table is one row a task before anything
  is shuffled.
* **In partitions by hash and length** those terminals meet, sorted, in a second trie, which finds the
  owner and the size of each class and hands them back to the terminals that it was made of.
* A join on ``rep`` gives them to the rows, without their texts.

Tries spill by subtree: when the edges of the first hold more than ``SPILL`` bytes, its heaviest
subtrees leave as rows until half is left (a text that comes again starts a new terminal, which
the second trie merges); the second, whose keys come in order, lets go of all that lies left
of the open key's path. The spilled rows go on into Spark's own shuffle, so no task writes files of its own.

Texts are equal if they are after lower-casing A-Z only; null counts as empty. Of rows that repeat the owner's
id and have equal texts, the one that was read first stays, so one row of each class does. A null id never beats another;
a class of null ids has a null owner and still keeps one row. Further columns pass through in ``row``
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, cut

#: Bytes on the edges of a task's trie.
SPILL = 24 << 20
#: What a node takes besides its edge.
_NODE = 300
#: Rows of an output batch.
_ROWS = 4_096
_NEVER = 1 << 62


def common(a: bytes, b: bytes, at: int) -> int:
    """How many bytes of ``a`` are those of ``b`` from ``at`` on."""
    lo, hi = 0, min(len(a), len(b) - at)
    if a[:hi] == b[at : at + hi]:
        return hi
    while hi - lo > 1:  # the first lo bytes agree, the first hi don't
        mid = (lo + hi) // 2
        if a[lo:mid] == b[at + lo : at + mid]:
            lo = mid
        else:
            hi = mid
    return lo


class Node:
    __slots__ = ("edge", "below", "terminal")

    def __init__(self, edge: bytes, terminal: list | None = None) -> None:
        self.edge, self.below, self.terminal = edge, {}, terminal


class Trie:
    """Keys on compressed edges, and a terminal where each ends."""

    def __init__(self) -> None:
        self.root, self.held = Node(b""), 0

    def terminal(self, key: bytes) -> list | None:
        """The list that stands where ``key`` ends, empty if the key is new."""
        node, at = self.root, 0
        while at < len(key):
            child = node.below.get(key[at])
            if child is None:
                child = Node(key[at:], [])
                node.below[key[at]] = child
                self.held += len(child.edge) + _NODE
                return child.terminal
            if not key.startswith(child.edge, at):
                upto = common(child.edge, key, at)
                upper = Node(child.edge[:upto])
                child.edge = child.edge[upto:]
                upper.below[child.edge[0]] = child
                node.below[key[at]] = upper
                self.held += _NODE
                child = upper
            at += len(child.edge)
            node = child
        if node.terminal is None:
            node.terminal = []
        return node.terminal

    def spilled(self, path: bytes, node: Node) -> Iterator[tuple[bytes, list]]:
        """Keys and terminals of a subtree that has been cut off, in order."""
        open_ = [(path, node)]
        while open_:
            path, node = open_.pop()
            path += node.edge
            self.held -= len(node.edge) + _NODE
            if node.terminal is not None:
                yield path, node.terminal
            open_.extend((path, node.below[k]) for k in sorted(node.below, reverse=True))

    @staticmethod
    def _weight(node: Node) -> int:
        total, open_ = 0, [node]
        while open_:
            node = open_.pop()
            total += len(node.edge) + _NODE
            open_.extend(node.below.values())
        return total

    def heaviest(self) -> Iterator[tuple[bytes, list]]:
        """Cut subtrees off, heaviest first, until half of what is held is left."""
        most = self.held // 2
        for _, k in sorted(((self._weight(x), k) for k, x in self.root.below.items()), reverse=True):
            if self.held <= most:
                break
            yield from self.spilled(b"", self.root.below.pop(k))

    def before(self, key: bytes) -> Iterator[tuple[bytes, list]]:
        """Cut off every subtree left of the path of ``key``, which no later key can reach."""
        node, at = self.root, 0
        while node is not None and at < len(key):
            for k in sorted(k for k in node.below if k < key[at]):
                yield from self.spilled(key[:at], node.below.pop(k))
            child = node.below.get(key[at])
            if child is None or not key.startswith(child.edge, at):
                return
            at += len(child.edge)
            node = child

    def rest(self) -> Iterator[tuple[bytes, list]]:
        root, self.root = self.root, Node(b"")
        self.held += _NODE  # the root was never counted
        yield from self.spilled(b"", root)


_HEAD = 16  # bytes of a key before its text: hash, length


def _key(text: bytes) -> bytes:
    return xxhash.xxh64_digest(text) + len(text).to_bytes(8, "big") + text


def _owned(largest: bool):
    """The order of owners, as a number of which the smallest wins; null ids come last."""

    def rank(identifier: int | None) -> int:
        return _NEVER * 4 if identifier is None else -identifier if largest else identifier

    return rank


def _first(largest: bool, spill: int):
    """Rows into a task's trie: a row each (kind 0), and one a terminal with its text (kind 1)."""
    rank = _owned(largest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, pack = Trie(), zstandard.ZstdCompressor(level=1)
        row_type = None

        def terminals(found: Iterator[tuple[bytes, list]]) -> Iterator[pa.RecordBatch]:
            rows, held = [], 0

            def made() -> pa.RecordBatch:
                key, rep, uid, owner, n, packed = zip(*rows, strict=True)
                k = len(rows)
                return pa.RecordBatch.from_arrays(
                    [pa.nulls(k, row_type), pa.array([1] * k, pa.int8()), pa.array(uid, pa.int64()), pa.array(rep, pa.int64()), pa.nulls(k, pa.string()), pa.array(key, pa.binary()), pa.array(owner, pa.int64()), pa.array(n, pa.int64()), pa.array(packed, pa.binary())],
                    ["row", "kind", "uid", "rep", "text_sha256", "head", "owner", "n", "ztext"],
                )

            for key, (rep, _, uid, owner, n) in found:
                rows.append((key[:_HEAD], rep, uid, owner, n, pack.compress(key[_HEAD:])))
                held += len(rows[-1][5])
                if len(rows) == _ROWS or held > (4 << 20):
                    yield made()
                    rows, held = [], 0
            if rows:
                yield made()

        for batch in batches:
            names = batch.schema.names
            rows = batch.column(names.index("row"))
            row_type = rows.type
            uids, owners = batch.column(names.index("uid")).to_pylist(), batch.column(names.index("id")).to_pylist()
            reps, digests = [], []
            for text, uid, owner in zip(batch.column(names.index("bytes")), uids, owners, strict=True):
                text = (text.as_py() or b"").lower()  # of bytes: A-Z only
                here, mine = trie.terminal(_key(text)), (rank(owner), uid)
                if not here:
                    here[:] = [uid, *mine, owner, 0]
                elif mine < (here[1], here[2]):
                    here[1:4] = [*mine, owner]
                here[4] += 1
                reps.append(here[0])
                digests.append(hashlib.sha256(text).hexdigest())
                if trie.held > spill:
                    yield from terminals(trie.heaviest())
            k = len(batch)
            yield pa.RecordBatch.from_arrays(
                [rows, pa.array([0] * k, pa.int8()), batch.column(names.index("uid")), pa.array(reps, pa.int64()), pa.array(digests), pa.nulls(k, pa.binary()), batch.column(names.index("id")), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())],
                ["row", "kind", "uid", "rep", "text_sha256", "head", "owner", "n", "ztext"],
            )
        yield from terminals(trie.rest())

    return run


def _second(largest: bool, spill: int):
    """Sorted terminals into one trie a partition: owner and size of each class, for each that it was made of."""
    rank = _owned(largest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, unpack = Trie(), zstandard.ZstdDecompressor()

        def classes(found: Iterator[tuple[bytes, list]]) -> Iterator[pa.RecordBatch]:
            rep, uid, owner, n = [], [], [], []

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(uid, pa.int64()), pa.array(owner, pa.int64()), pa.array(n, pa.int64())], ["rep", "owner_uid", "keep_id", "group_size"])

            for _, (_, keep, best, size, reps) in found:
                for r in reps:
                    rep.append(r), uid.append(keep), owner.append(best), n.append(size)
                    if len(rep) == _ROWS:
                        yield made()
                        rep, uid, owner, n = [], [], [], []
            if rep:
                yield made()

        for batch in batches:
            names = batch.schema.names
            column = [batch.column(names.index(c)) for c in ("head", "ztext", "rep", "uid", "owner", "n")]
            for head, packed, rep, uid, owner, n in zip(*column, strict=True):
                key = head.as_py() + unpack.decompress(packed.as_py())
                if trie.held > spill:
                    yield from classes(trie.before(key[:_HEAD]))
                here, mine = trie.terminal(key), (rank(owner.as_py()), uid.as_py())
                if not here:
                    here[:] = [*mine, owner.as_py(), 0, []]
                elif mine < (here[0], here[1]):
                    here[:3] = [*mine, owner.as_py()]
                here[3] += n.as_py()
                here[4].append(rep.as_py())
        yield from classes(trie.rest())

    return run


def owners(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", largest: bool = True, spill: int = SPILL) -> DataFrame:
    """One row per input row: ``row`` (its columns but the text), ``keep_id, group_size, kept, text_sha256``.

    The row of the largest id of its class stays (of the smallest, unless ``largest``).
    """
    bounded_batches(docs.sparkSession)
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    base = docs.select(F.col(f"`{text}`").cast("string").cast("binary").alias("bytes"), F.col(f"`{doc_id}`").cast("long").alias("id"), others.alias("row"), F.monotonically_increasing_id().alias("uid"))
    kind = base.schema["row"].dataType.simpleString()
    read = cut(base.mapInArrow(_first(largest, spill), f"row {kind}, kind byte, uid long, rep long, text_sha256 string, head binary, owner long, n long, ztext binary"))
    ends = read.where("kind = 1").select("head", "rep", "uid", "owner", "n", "ztext")
    ends = ends.repartition("head").sortWithinPartitions("head")
    classes = cut(ends.mapInArrow(_second(largest, spill), "rep long, owner_uid long, keep_id long, group_size long"))
    rows = read.where("kind = 0").select("row", "uid", "rep", "text_sha256").join(classes, "rep")
    return rows.select("row", "keep_id", "group_size", (F.col("uid") == F.col("owner_uid")).alias("kept"), "text_sha256")
