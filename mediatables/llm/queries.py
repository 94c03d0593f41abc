"""The registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, embdedup, exact, fim, hardneg, html, langid, minhash, mixing, suffix, tokencount, warc

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the public vocabulary files lie (a parameter of the operators)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(_table(spark, sf_dir, "pages"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_vectors(_table(spark, sf_dir, "embeddings"), 0.9)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.page_responses(_table(spark, sf_dir, "pages"))).drop("block")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of documents from text and source; the label that the model is fitted on is no evidence."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    languages, model = langid.fit(docs, "text", "lang", "doc_id")
    found = langid.identify(docs.drop("lang"), languages, model, host=F.col("source"))
    return found.select("doc_id", F.col("language.lang").alias("lang"), F.round("language.posterior", 6).alias("posterior"), F.col("language.evidence").alias("text_lang"), F.col("language.accepted").alias("kept"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), vocabulary_path())


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), vocabulary_path(), 512)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix.remove_repeats(docs).select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.owners(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("row.doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = [F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return made.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, shifted)


def lang_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of pages from text, declared language, address suffix and host."""
    docs = _table(spark, sf_dir, "documents")
    languages, model = langid.fit(docs, "text", "lang", "doc_id")
    pages = _table(spark, sf_dir, "pages").select("page_id", langid.host_of(F.col("url")).alias("host"), F.regexp_extract("html", r'(?i)<html[^>]*\slang="?([A-Za-z-]+)', 1).alias("declared"), warc.plain_text(F.col("html")).alias("text"))
    found = langid.identify(pages, languages, model, declared="declared", host=F.col("host"))
    return found.select("page_id", F.col("language.lang").alias("lang"), F.round("language.posterior", 6).alias("posterior"), F.col("language.accepted").alias("kept"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_ann, op2_html, op3_embedding_dedup, op4_warc, op5_language_id, op6_bpe, op7_token_counts, op8_minhash, op9_mixing, op10_suffix_array, op11_exact, op12_fim, op13_hard_negatives, lang_pages, pipeline)}


def _warc_sql() -> str:
    text = f"regexp_replace(coalesce(html, ''), '{warc._HIDDEN_PATTERN}', ' ', 'g')"
    text = rf"regexp_replace({text}, '[\t\n\x0B\f\r ]+', ' ', 'g')"
    text = f"regexp_replace({text}, '{warc._LINE_PATTERN}', chr(10), 'g')"
    text = f"regexp_replace({text}, '<[a-zA-Z/!?][^>]*>', '', 'g')"
    known = [(name[1:-1], char.replace("'", "''")) for name, char in warc.REFERENCES if name[1] != "#"]
    legacy = "|".join(n for n, _ in known if n in warc.WITHOUT_SEMICOLON)
    names, chars = ("[" + ", ".join(f"'{x[k]}'" for x in known) + "]" for k in (0, 1))
    value = lambda name: f"list_extract({chars}, list_position({names}, {name}))"
    one = (
        rf"CASE WHEN regexp_matches(t, '^&#[0-9]') THEN chr(regexp_extract(t, '^&#([0-9]+)', 1)::INT) || regexp_replace(t, '^&#[0-9]+;?', '') "
        rf"WHEN regexp_matches(t, '^&#[xX][0-9a-fA-F]') THEN chr(('0x' || regexp_extract(t, '^&#[xX]([0-9a-fA-F]+)', 1))::INT) || regexp_replace(t, '^&#[xX][0-9a-fA-F]+;?', '') "
        rf"WHEN list_contains({names}, regexp_extract(t, '^&([a-zA-Z]+);$', 1)) THEN {value("regexp_extract(t, '^&([a-zA-Z]+);$', 1)")} "
        rf"WHEN regexp_matches(t, '^&({legacy})') THEN {value(f"regexp_extract(t, '^&({legacy})', 1)")} || regexp_replace(t, '^&({legacy});?', '') ELSE t END"
    )
    text = f"array_to_string(list_transform(regexp_extract_all({text}, '&[#a-zA-Z0-9]*;?|[^&]+'), lambda t: {one}), '')"
    text = rf"regexp_replace({text}, '[ ]*\n[ \n]*', chr(10), 'g')"
    text = rf"regexp_replace({text}, '^[ \n]+|[ \n]+$', '', 'g')"

    def name(kind: str) -> str:
        return f"'<urn:uuid:' || substr({kind},1,8) || '-' || substr({kind},9,4) || '-' || substr({kind},13,4) || '-' || substr({kind},17,4) || '-' || substr({kind},21,12) || '>'"

    return f"""
WITH r AS (
  SELECT page_id, coalesce(url, '') AS target_uri, '{warc.DATE}' AS date, coalesce(html, '') AS html, md5('response|' || page_id || '|' || coalesce(url, '')) AS h,
         'sha256:' || sha256(coalesce(html, '')) AS source_digest FROM pages),
s AS (SELECT *, {name('h')} AS source_id FROM r),
k AS (
  SELECT *, 'metadata' AS record_type, 'application/json' AS content_type,
    to_json({{'WARC-Refers-To': source_id, 'WARC-Target-URI': target_uri, 'WARC-Date': date, 'WARC-Payload-Digest': source_digest,
      'HTTP-Headers': ['HTTP/1.1 200 OK', 'Content-Type: text/html; charset=utf-8', 'Content-Length: ' || strlen(html)],
      'Title': regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), 'Links': regexp_extract_all(html, '(?i)<a\\s[^>]*?href="([^"]*)"', 1)}})::VARCHAR AS block FROM s
  UNION ALL SELECT *, 'conversion', 'text/plain', {text} FROM s),
d AS (SELECT *, md5(record_type || '|' || source_id) AS h2 FROM k)
SELECT page_id, record_type, {name('h2')} AS record_id, source_id AS refers_to, target_uri, date, content_type, strlen(block)::BIGINT AS content_length,
  'sha256:' || sha256(block) AS block_digest, source_digest FROM d"""


_FIM_SQL = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
k AS (SELECT doc_id, t, length(t) AS n, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2, ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM h),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || substring(t, 1, a) || '<S>' || substring(t, b + 1) || '<M>' || substring(t, a + 1, b - a)
    ELSE '<S>' || substring(t, b + 1) || '<P>' || substring(t, 1, a) || '<M>' || substring(t, a + 1, b - a) END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM c"""

_EXACT_SQL = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256 FROM t WINDOW w AS (PARTITION BY x)"""

_NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""

ORACLES = {"op4_warc": _warc_sql(), "op11_exact": _EXACT_SQL, "op12_fim": _FIM_SQL, "op13_hard_negatives": _NEGATIVES_SQL}
