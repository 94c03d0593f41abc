"""Fill-in-middle transformation over a piecewise-linear learned rank index.

A text is UTF-8 bytes, and a cut is named by its rank among code points. :class:`RankIndex`
learns where the boundaries lie: straight segments over all boundary offsets of a text, each
within ``ERROR`` bytes of every boundary that it covers, and the residual of each boundary, which
fits in one signed byte. A cut is the prediction of its segment plus its residual, which is its exact
offset. Segments are fitted by halving: a line through the ends of a stretch stays if it is
within the bound everywhere, else both halves are tried. So plain ASCII takes one segment,
any text at most ``n / 2``, and the passes are logarithmic.

Texts are independent: nothing is shuffled, and a lost task is run again alone. The two cuts and the
form come from a hash of the id, so reruns agree. Null texts count as empty and stay plain, as do
texts that bear a marker; a null id hashes as no digits. Rows that repeat an id and a text get one
result each. Further columns pass through in ``row`` whatever their names; an empty table
gives an empty table. Bytes that are no UTF-8 count by their leading bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, by_bytes

#: Most bytes that a segment may be off; residuals are signed bytes.
ERROR = 127
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of texts whose boundaries are fitted together (a longer text by itself).
_TOGETHER = 1 << 20


class RankIndex:
    """Where code points begin in some texts that lie one after the other."""

    def __init__(self, texts: list[bytes]) -> None:
        data = np.frombuffer(b"".join(texts), np.uint8)
        size = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(size)
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        self.first = np.searchsorted(starts, ends - size) + np.arange(len(texts))  # of each text's own boundaries; its end is one too
        self.count = np.searchsorted(starts, ends) - np.searchsorted(starts, ends - size)
        text = np.searchsorted(ends, starts, side="right")
        self.offset = np.zeros(len(starts) + len(texts), np.int64)
        self.offset[np.arange(len(starts)) + text] = starts - (ends - size)[text]
        self.offset[self.first + self.count] = size
        self._fit()

    def _fit(self) -> None:
        lo, hi = self.first, self.first + self.count  # both ends of a stretch belong to it
        done = []
        self.residual = np.zeros(len(self.offset), np.int8)
        while len(lo):
            length = hi - lo + 1
            begin = np.cumsum(length) - length
            own = np.repeat(np.arange(len(lo)), length)
            place = np.arange(len(own)) - begin[own] + lo[own]
            rise, run = self.offset[hi] - self.offset[lo], np.maximum(hi - lo, 1)
            off = self.offset[place] - self.offset[lo][own] - (place - lo[own]) * rise[own] // run[own]
            near = np.maximum.reduceat(np.abs(off), begin) <= ERROR
            kept = near[own]
            self.residual[place[kept]] = off[kept]
            done.append((lo[near], self.offset[lo[near]], rise[near], run[near]))
            a, b = lo[~near], hi[~near]
            mid = (a + b) // 2
            lo, hi = np.concatenate((a, mid + 1)), np.concatenate((mid, b))
        begin, base, rise, run = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.empty(0, np.int64),) * 4
        order = np.argsort(begin)
        self.begin, self.base, self.rise, self.run = begin[order], base[order], rise[order], run[order]
        del self.offset  # segments and residuals say it all

    def at(self, text: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The byte at which code point ``rank`` of each text begins (or the text ends)."""
        place = self.first[text] + rank
        segment = np.searchsorted(self.begin, place, side="right") - 1
        predicted = self.base[segment] + (place - self.begin[segment]) * self.rise[segment] // self.run[segment]
        return predicted + self.residual[place]


def _arranged(plain: int, spm: int, markers: tuple[bytes, bytes, bytes]):
    p, s, m = markers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            texts = [x or b"" for x in column["bytes"].to_pylist()]
            h = [column[f"h{k}"].to_numpy() for k in range(1, 5)]
            for a, b in by_bytes(texts, _TOGETHER):
                some = texts[a:b]
                index = RankIndex(some)
                n, which = index.count, np.arange(b - a)
                one, two = h[0][a:b] % (n + 1), h[1][a:b] % (n + 1)
                first, second = np.minimum(one, two), np.maximum(one, two)
                x, y = index.at(which, first), index.at(which, second)
                stays = (n == 0) | (h[2][a:b] % 100 >= 100 - plain) | np.array([any(k in t for k in markers) for t in some], bool)
                back = h[3][a:b] % 100 < spm
                form, output = [], []
                for t, i, j, keep, turned in zip(some, x, y, stays, back, strict=True):
                    head, mid, tail = t[:i], t[i:j], t[j:]
                    form.append("plain" if keep else "spm" if turned else "psm")
                    output.append(t if keep else s + tail + p + head + m + mid if turned else p + head + s + tail + m + mid)
                yield pa.RecordBatch.from_arrays(
                    [column["row"].slice(a, b - a), pa.array(n, pa.int64()), pa.array(form), pa.array(first, pa.int64(), mask=stays), pa.array(second - first, pa.int64(), mask=stays), pa.array(output, pa.binary())],
                    ["row", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return run


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: int = 1, plain: int = 10, spm: int = 20, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """One row per input row: ``row`` (its columns but the text), ``n, form, prefix_chars, middle_chars, output``.

    ``plain`` of a hundred texts stay as they are, ``spm`` of a hundred others have the suffix first.
    Lengths are in code points, null where the text stays plain.
    """
    bounded_batches(docs.sparkSession)
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text])
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    base = docs.select(F.col(f"`{text}`").cast("string").cast("binary").alias("bytes"), others.alias("row"), *hashes)
    kind = base.schema["row"].dataType.simpleString()
    made = base.mapInArrow(_arranged(plain, spm, tuple(x.encode() for x in markers)), f"row {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text again, from an output and its form alone.

    A text that was cut bears no marker and no marker's end is the start of another, so each
    marker's first place is its own.
    """
    p, s, m = markers

    def parts(first: str, second: str, third: str) -> list[Column]:
        inner = F.substring(output, len(first) + 1, 2**31 - 1)
        halves = F.split(inner, _literal(second), 2)
        rest = F.split(halves[1], _literal(third), 2)
        return [halves[0], rest[0], rest[1]]

    psm, spm = parts(p, s, m), parts(s, p, m)
    return F.when(form == "plain", output).when(form == "psm", F.concat(psm[0], psm[2], psm[1])).otherwise(F.concat(spm[1], spm[2], spm[0]))


def _literal(marker: str) -> str:
    return "\\Q" + marker + "\\E"
