"""A corpus from raw documents to token ids, a stage per operator.

``STAGES`` lists the stages in order. Each takes ``(spark, docs, sf_dir)`` and returns the rows
that the next one gets; :func:`run` writes each stage's rows in the shared folder and reads
them again, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediatables.llm import bpe, langid, minhash, mixing, suffix
from mediatables.llm.queries import vocabulary_path
from mediatables.llm.shared import cut

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Words of a repeated passage that ``cut_repeats`` removes, and the bytes of a repeat that it looks for:
#: 51 words have a letter each and 50 spaces at least. Repeats of fewer words, as license lines, stay.
REPEAT_WORDS = 51
REPEAT_BYTES = 2 * REPEAT_WORDS - 1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, with the identified language as ``lang``.

    The given ``lang`` labels the rows that the model is fitted on and is no evidence itself. Null, empty
    and letterless texts go; the whole of a long text is read; repeated rows share their fate; ties
    go to the first language in code point order. A null source is a host of its own. An empty
    table gives an empty one. Columns beyond ``COLUMNS`` are not handed on, whatever their names.
    """
    languages, model = langid.fit(docs, "text", "lang", "doc_id")
    found = langid.identify(docs, languages, model, host=F.col("source"))
    return found.where("language.accepted").withColumn("lang", F.col("language.lang")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the smallest id, of each group of near copies.

    A row without an id takes part under a number of its text, beyond any usual id, so it stays
    unless it is a near copy of another; its ``doc_id`` stays null. Of rows that repeat an id
    and a text one stays; rows of one id with different texts stay or go together. Null and
    empty texts link with nothing and stay; ties go to the smallest id. The similarity is 0.8, that
    of near-duplicate stages; the query ``op8_minhash`` has 0.85 by its own contract. An
    empty table gives an empty one, and further columns are not handed on.
    """
    number = F.col("doc_id").cast("long")
    docs = docs.withColumn("number", F.coalesce(number, F.xxhash64("text").bitwiseAND(F.lit((1 << 62) - 1)) + F.lit(1 << 62)))
    groups = minhash.near_duplicates(docs, doc_id="number", percent=80).where("kept").select(F.col("doc_id").alias("number"))
    kept = cut(docs.groupBy("number").agg(F.count("*").alias("n")).join(groups, "number", "left_semi"))
    single = docs.join(kept.where("n = 1"), "number", "left_semi").select(*COLUMNS)
    several = docs.join(kept.where("n > 1"), "number", "left_semi").groupBy("number", "text").agg(F.min(F.struct("doc_id", "lang", "source", "n_chars")).alias("one"))
    return single.union(several.select("one.doc_id", "text", "one.lang", "one.source", "one.n_chars"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of over 50 words that repeat: every ``REPEAT_WORDS`` words in a row that occur again.

    They are looked for in runs of repeated strings of ``REPEAT_BYTES``, in which all of them lie; a run
    that is pieced together from shorter repeats stays. Bytes left of a cut character go too. Every row stays, if need be with an empty text; null texts
    become empty. Rows that repeat are copies of each other and lose all of a long text. An empty table
    gives an empty one, and further columns are not handed on.
    """
    kept = suffix.remove_repeats(docs, length=REPEAT_BYTES, words=REPEAT_WORDS)
    text = F.when(F.col("n_removed") > 0, _valid("kept")).otherwise(F.decode("kept", "UTF-8"))
    return kept.select(*[text.alias("text") if c == "text" else F.col(f"row.{c}").alias(c) for c in COLUMNS]).withColumn("n_chars", F.length("text").cast("long"))


def _valid(column: str):
    """UTF-8 bytes as text, without the replacement characters of broken sequences."""
    return F.when(F.is_valid_utf8(F.col(column).cast("string")), F.col(column).cast("string")).otherwise(F.replace(F.make_valid_utf8(F.col(column).cast("string")), F.lit("�"), F.lit("")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it.

    Null and empty texts have no words and are taken as the running order has it; null is a source
    of its own. Rows equal in source, id and size are taken alike. An empty table gives an empty one.
    """
    return mixing.mixed(docs).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, their number, and whether they decode to it.

    Null and empty texts have no ids. Rows are independent, repeated or not; whole texts are encoded.
    An empty table gives an empty one.
    """
    out = bpe.encoded_and_checked(docs.select("doc_id", "lang", "source", "text"), vocabulary_path())
    return out.select("row.doc_id", "row.lang", "row.source", F.size("token_ids").cast("long").alias("n_tokens"), "round_trip", "token_ids")


STAGES = [("language_id", identify_language), ("near_duplicates", drop_near_duplicates), ("repeated_strings", cut_repeats), ("mixing", mix_sources), ("tokens", tokenize)]

#: No SQL expresses the trained language model and the byte-level merges; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
