"""Token counts with a whole-token shortcut.

Before any text is read it is proved which vocabulary strings encode alone as one token:
each is merged from its bytes and kept only if it cuts as one pre-token and ends as one
id. A pre-token found in that table counts one without being merged; only the rest are
merged (and remembered, in a memo of bounded size). The proof costs a second for fifty
thousand strings, runs once per vocabulary on the driver, and its result is broadcast;
both sizes are the vocabulary's.

Counting is one pass without a shuffle. Null text counts as empty: no bytes, no tokens,
not over any limit. Rows are independent; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import MEMO, PATTERN, Encoder, Memo, Vocabulary, merged_words, texts_together
from .shared import bounded_batches, kept


def whole_tokens(vocabulary: Vocabulary) -> frozenset[str]:
    """The vocabulary strings that are one pre-token and encode alone as one token."""
    find, able = regex.compile(PATTERN).findall, []
    for raw in vocabulary.bytes_of.values():
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if text and text not in vocabulary.special and find(text) == [text]:
            able.append(text)
    return frozenset(text for text, ids in zip(able, merged_words([t.encode() for t in able], vocabulary)) if len(ids) == 4)


class Counter:
    """Counts tokens of texts; ``one`` says which pre-tokens are one token."""

    def __init__(self, vocabulary: Vocabulary, one: frozenset[str], most: int = MEMO) -> None:
        self.encoder = Encoder(vocabulary, 1)
        self.sizes = Memo(vocabulary, most, lambda ids: len(ids) // 4, dict.fromkeys(one, 1))

    def counts(self, texts: Iterable[str | None]) -> Iterator[int]:
        for held in texts_together(texts):
            cuts = [self.encoder.pieces(text) for text in held]
            size = self.sizes.learn(set().union(*[tokens for cut in cuts for _, tokens in cut])).__getitem__
            for cut in cuts:
                yield sum([1 if special is not None else sum(map(size, tokens)) for special, tokens in cut])


def token_counts(docs: DataFrame, path: str, limit: int = 512, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per text: ``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens)."""
    bounded_batches(docs.sparkSession)
    vocabulary = Vocabulary(path)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, whole_tokens(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept("counter", shared.value, lambda: Counter(*shared.value))
        for batch in batches:
            n = list(counter.counts(t.as_py() for t in batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array([x > limit for x in n])], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    base = base.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return base.mapInArrow(run, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
