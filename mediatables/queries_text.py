"""Registered queries over corpora, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text as T
from .operators import text as ops


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def _lines(spark, d):
    """Collapsed lines of all documents as paragraphs."""
    return ops.explode_paragraphs(ops.normalize_corpus(_docs(spark, d).select("doc_id", "text"), "prose"), "prose", True)


def _paragraphs(spark, d):
    return ops.explode_paragraphs(ops.normalize_corpus(_docs(spark, d).select("doc_id", "text")))


def _broken(chunks):
    """A chunk table whose rows break each promise in turn, by their place in their document."""
    k = F.pmod("chunk_index", F.lit(97))
    text = F.when(k == 3, F.concat(F.lit(" "), "text")).when(k == 11, F.lit("")).when(k == 23, F.concat("text", F.repeat(F.lit("x"), F.lit(120)))).otherwise(F.col("text"))
    count = F.when(k == 31, F.col("char_count") + 1).otherwise(F.length(text))
    index = F.when(k == 41, F.col("chunk_index") + 1).otherwise(F.col("chunk_index"))
    paragraph = F.when(k == 53, F.lit(-1)).otherwise(F.col("paragraph_index"))
    return chunks.select("doc_id", index.alias("chunk_index"), paragraph.alias("paragraph_index"), text.alias("text"), count.alias("char_count"))


QUERIES = {
    "normalize_narration": lambda s, d: ops.normalize_corpus(_docs(s, d)).select("doc_id", F.md5("text").alias("text_md5")),
    "normalize_prose": lambda s, d: ops.normalize_corpus(_docs(s, d), "prose").select("doc_id", F.md5("text").alias("text_md5")),
    "paragraphs_narration": lambda s, d: _paragraphs(s, d).select("doc_id", F.col("paragraph_index").cast("long").alias("paragraph_index"), F.md5("text").alias("text_md5")),
    "paragraphs_prose": lambda s, d: _lines(s, d).select("doc_id", F.col("paragraph_index").cast("long").alias("paragraph_index"), F.md5("text").alias("text_md5")),
    "protected_spans": lambda s, d: ops.protected_spans(_docs(s, d)).select("doc_id", F.col("position").cast("long").alias("position"), "span"),
    "sentences_narration": lambda s, d: ops.explode_sentences(_paragraphs(s, d)).groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.length("text")).alias("chars"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph_index", "sentence_index", "text"))), lambda x: x["text"]), "|")).alias("text_md5")),
    "sentences_prose": lambda s, d: ops.explode_sentences(_lines(s, d), "prose").groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.length("text")).alias("chars"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paragraph_index", "sentence_index", "text"))), lambda x: x["text"]), "|")).alias("text_md5")),
    "chunk_corpus_narration": lambda s, d: ops.chunk_corpus(_docs(s, d)).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("paragraph_index").cast("long").alias("paragraph_index"), F.md5("text").alias("text_md5"), F.col("char_count").cast("long").alias("char_count"), "ends_paragraph"),
    "chunk_corpus_merged": lambda s, d: ops.chunk_corpus(_docs(s, d), merge=True).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("paragraph_index").cast("long").alias("paragraph_index"), F.col("char_count").cast("long").alias("char_count"), F.md5("text").alias("text_md5")),
    "chunk_corpus_prose": lambda s, d: ops.chunk_corpus(_docs(s, d), "prose", newline_is_break=True).select("doc_id", "chunk_index", "paragraph_index", "char_count", "ends_paragraph", F.md5("text").alias("text_md5")),
    "narration_demand": lambda s, d: ops.narration_demand(_docs(s, d)),
    "chunk_size_stats": lambda s, d: ops.chunk_size_stats(ops.chunk_corpus(_docs(s, d))),
    "chunk_audit": lambda s, d: ops.chunk_audit(ops.chunk_corpus(_docs(s, d), max_chars=120), _docs(s, d), 120),
    "chunk_audit_broken": lambda s, d: ops.chunk_audit(_broken(ops.chunk_corpus(_docs(s, d), max_chars=120)), _docs(s, d), 120).groupBy("doc_id", "violation").agg(F.count("*").alias("n")),
    "speech_estimate": lambda s, d: s.read.parquet(f"{d}/conversations.parquet").groupBy("conv_id").agg(F.round(F.sum(T.estimated_seconds(F.col("text"))), 6).alias("seconds")),
}


def _q(x: str) -> str:
    return x.replace("'", "''")


_NARRATION = "nfc_normalize(replace(replace(replace(text, chr(65279), ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)))"
_WHITE = r"[\s\x0B\x85\p{Z}]"
_COLLAPSED = rf"trim(regexp_replace(p, '{_WHITE}+', ' ', 'g'))"
_LINE = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(l, '^\s{{0,3}}#{{1,6}}\s+', ''), '^\s*>\s?', ''), '^\s*(?:[-*•‣◦▪]|\d{{1,3}}[.)]|[a-zA-Z][.)])\s+', ''), '[ ]{{2,}}', ' ', 'g'), '^{_WHITE}+|{_WHITE}+$', '', 'g')"""
_MAPPED = f"replace(replace(translate(translate(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '{_q(T.QUOTES_FROM)}', '{_q(T.QUOTES_TO)}'), '{T.QUOTES_DROP}', ''), '**', ''), '`', '')"
_PROSE = rf"regexp_replace(regexp_replace(array_to_string(list_transform(string_split({_MAPPED}, chr(10)), lambda l: {_LINE}), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
_BULLETS = T.BULLET.replace("\\S", "").replace("^", "")
_MARKED = rf"regexp_replace({_NARRATION}, '(?m)^({_BULLETS})', chr(10) || chr(10) || '\1', 'g')"


def _listed(parts: str) -> str:
    return f"list_filter(list_transform({parts}, lambda p: {_COLLAPSED}), lambda p: p <> '')"


_P_NARRATION = f"SELECT doc_id, unnest(ps) AS text, generate_subscripts(ps, 1) - 1 AS paragraph_index FROM (SELECT doc_id, {_listed(rf'''regexp_split_to_array({_MARKED}, '\n[ \t]*\n+')''')} AS ps FROM documents)"
_P_PROSE = f"SELECT doc_id, unnest(ps) AS text, generate_subscripts(ps, 1) - 1 AS paragraph_index FROM (SELECT doc_id, {_listed(f'string_split({_PROSE}, chr(10))')} AS ps FROM documents)"


def _fold(pieces: str, breaks: str) -> str:
    """Pieces joined where ``breaks`` (over a.open and x) is false."""
    return f"""list_transform([list_reduce(list_prepend({{'out': []::VARCHAR[], 'open': ''}}, list_transform({pieces}, lambda y: {{'out': []::VARCHAR[], 'open': y}})),
      lambda a, b: CASE WHEN b.open = '' THEN a WHEN a.open <> '' AND ({breaks}) THEN {{'out': list_append(a.out, a.open), 'open': b.open}} ELSE {{'out': a.out, 'open': a.open || b.open}} END)],
      lambda r: CASE WHEN r.open = '' THEN r.out ELSE list_append(r.out, r.open) END)[1]"""


_C, _O = _q(T.CLOSERS), _q(T.OPENERS)


def _words(items) -> str:
    return ", ".join(f"'{x}'" for x in items)


def _end(group: int, closers: str) -> str:
    return rf"regexp_extract(a.open, '(\S*?)([.!?…]+)[{closers}]*\s*$', {group})"


_RUN, _TOKEN = _end(2, _C), _end(1, _C)
_BARE = f"regexp_replace({_TOKEN}, '^[{_O}]+', '')"
_N_BREAKS = rf"{_RUN} = '' OR NOT ({_RUN} LIKE '%…%' OR regexp_matches({_RUN}, '\..*\.') OR ({_RUN} = '.' AND (regexp_full_match({_BARE}, '\p{{Lu}}') OR lower({_BARE}) IN ({_words(T.ABBREVIATIONS)}) OR regexp_matches(b.open, '^\p{{Ll}}'))))"
_N_PIECES = rf"string_split(regexp_replace(regexp_replace(text, '([.!?…]+[{_C}]*) ', '\1 ' || chr(1), 'g'), '([。！？][{_C}]*) *', '\0' || chr(1), 'g'), chr(1))"
_PC = _q("\"'”’)\\]")
_PO = _q("\"'(\\[“‘")
_PRUN, _PTOKEN = _end(2, _PC), _end(1, _PC)
_PWORD = rf"regexp_replace(regexp_replace(regexp_replace(lower({_PTOKEN}), '^[{_PO}]+', ''), '[{_PO}]+$', ''), '\.+$', '')"
_LOWER = r"regexp_matches(b.open, '^\p{Ll}')"
_Q_BREAKS = rf"NOT (({_PRUN} = '.' AND (({_PWORD} <> '' AND ({_PWORD} IN ({_words(T.PROSE_ABBREVIATIONS)}) OR regexp_full_match({_PWORD}, '\p{{L}}') OR ({_PWORD} LIKE '%.%' AND NOT regexp_matches({_PWORD}, '[^.]{{3,}}')))) OR {_LOWER})) OR (regexp_matches({_PRUN}, '^(?:\..|…)') AND {_LOWER}))"
_Q_PIECES = rf"string_split(regexp_replace(text, '([.!?…]+[{_PC}]*\s+)', '\1' || chr(1), 'g'), chr(1))"


def _sentences(paragraphs: str, pieces: str, breaks: str) -> str:
    return f"""SELECT doc_id, count(*) AS sentences, sum(length(s))::BIGINT AS chars, md5(string_agg(s, '|' ORDER BY paragraph_index, k)) AS text_md5 FROM (
  SELECT doc_id, paragraph_index, trim(unnest(ss)) AS s, generate_subscripts(ss, 1) AS k FROM (SELECT doc_id, paragraph_index, {_fold(pieces, breaks)} AS ss FROM ({paragraphs}))) GROUP BY doc_id"""


def _pack(pieces: str, most: int, split: str) -> str:
    """Greedy packing; ``split`` turns x into a list."""
    flush = "CASE WHEN a.open = '' THEN a.out ELSE list_append(a.out, rtrim(a.open)) END"
    return f"""list_filter(list_transform([list_reduce(list_prepend({{'out': []::VARCHAR[], 'open': ''}}, list_transform({pieces}, lambda y: {{'out': []::VARCHAR[], 'open': y}})),
      lambda a, b: CASE WHEN length(rtrim(b.open)) > {most} THEN {{'out': list_concat({flush}, {split}), 'open': ''}}
        WHEN a.open <> '' AND length(rtrim(a.open || b.open)) <= {most} THEN {{'out': a.out, 'open': a.open || b.open}} ELSE {{'out': {flush}, 'open': b.open}} END)],
      lambda a: {flush})[1], lambda z: z <> '')"""


#: Sentences, clauses and words each become rows and are packed by their own fold, so that no fold nests in another.
def _chunk_sql(most: int) -> str:
    clause = rf"regexp_replace(regexp_replace(regexp_replace(rtrim(s), '([,;:—–)\]}}][{_q(chr(34) + chr(39))}’”]*) ', '\1 ' || chr(1), 'g'), '((?:^| )-+[{_q(chr(34) + chr(39))}’”]*) ', '\1 ' || chr(1), 'g'), ' ([{_O}])', ' ' || chr(1) || '\1', 'g')"
    joins = f"NOT regexp_matches(rtrim(a.open), '(?:{_q(T.PROTECTED)})$')"
    return f"""
WITH p AS ({_P_NARRATION}),
s AS (SELECT doc_id, paragraph_index, unnest(ss) AS s, generate_subscripts(ss, 1) AS si FROM (SELECT doc_id, paragraph_index, {_fold(_N_PIECES, _N_BREAKS)} AS ss FROM p WHERE length(text) > {most})),
c AS (SELECT doc_id, paragraph_index, si, unnest(cs) AS c, generate_subscripts(cs, 1) AS ci FROM (SELECT doc_id, paragraph_index, si, {_fold(f"string_split({clause}, chr(1))", joins)} AS cs FROM s WHERE length(rtrim(s)) > {most})),
w AS (SELECT doc_id, paragraph_index, si, ci, {_pack("string_split(regexp_replace(c, ' +', ' ' || chr(1), 'g'), chr(1))", most, f"list_transform(range(0, length(rtrim(b.open)), {most}), lambda k: substr(rtrim(b.open), k + 1, {most}))")} AS ws FROM c WHERE length(rtrim(c)) > {most}),
c2 AS (SELECT c.doc_id, c.paragraph_index, c.si, c.ci, c.c, w.ws FROM c LEFT JOIN w USING (doc_id, paragraph_index, si, ci)),
cp AS (SELECT doc_id, paragraph_index, si, {_packed_rows('c', 'ws', 'ci', most)} AS cs FROM c2 GROUP BY ALL),
s2 AS (SELECT s.doc_id, s.paragraph_index, s.si, s.s, cp.cs FROM s LEFT JOIN cp USING (doc_id, paragraph_index, si)),
sp AS (SELECT doc_id, paragraph_index, {_packed_rows('s', 'cs', 'si', most)} AS cs FROM s2 GROUP BY ALL),
a AS (SELECT doc_id, paragraph_index, cs FROM sp UNION ALL SELECT doc_id, paragraph_index, [text] FROM p WHERE length(text) <= {most}),
r AS (SELECT doc_id, paragraph_index, unnest(cs) AS text, generate_subscripts(cs, 1) AS k FROM a)
SELECT doc_id, row_number() OVER o - 1 AS chunk_index, paragraph_index, md5(text) AS text_md5, length(text) AS char_count, coalesce(lead(paragraph_index) OVER o <> paragraph_index, true) AS ends_paragraph, text FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY paragraph_index, k)"""


def _packed_rows(text: str, inner: str, order: str, most: int) -> str:
    flush = "CASE WHEN a.open = '' THEN a.out ELSE list_append(a.out, rtrim(a.open)) END"
    rows = f"list({{'out': coalesce({inner}, []::VARCHAR[]), 'open': {text}}} ORDER BY {order})"
    return f"""list_filter(list_transform([list_reduce(list_prepend({{'out': []::VARCHAR[], 'open': ''}}, {rows}),
      lambda a, b: CASE WHEN length(rtrim(b.open)) > {most} THEN {{'out': list_concat({flush}, b.out), 'open': ''}}
        WHEN a.open <> '' AND length(rtrim(a.open || b.open)) <= {most} THEN {{'out': a.out, 'open': a.open || b.open}} ELSE {{'out': {flush}, 'open': b.open}} END)],
      lambda a: {flush})[1], lambda z: z <> '')"""


def _merge_sql(chunks: str, most: int) -> str:
    return f"""
WITH m AS (SELECT doc_id, list_reduce(list_prepend({{'out': []::STRUCT(p BIGINT, t VARCHAR)[], 'p': NULL::BIGINT, 't': NULL::VARCHAR}},
    list({{'out': []::STRUCT(p BIGINT, t VARCHAR)[], 'p': paragraph_index::BIGINT, 't': text}} ORDER BY chunk_index)),
  lambda a, b: CASE WHEN a.t IS NULL THEN b WHEN length(a.t) + 1 + length(b.t) <= {most} THEN {{'out': a.out, 'p': a.p, 't': a.t || ' ' || b.t}}
    ELSE {{'out': list_append(a.out, {{'p': a.p, 't': a.t}}), 'p': b.p, 't': b.t}} END) AS r FROM ({chunks}) GROUP BY doc_id),
u AS (SELECT doc_id, unnest(c) AS x, generate_subscripts(c, 1) - 1 AS chunk_index FROM (SELECT doc_id, list_append(r.out, {{'p': r.p, 't': r.t}}) AS c FROM m))
SELECT doc_id, chunk_index, x.p AS paragraph_index, length(x.t) AS char_count, md5(x.t) AS text_md5 FROM u"""


def _audit_sql(most: int) -> str:
    squeezed = rf"regexp_replace(text, '{_WHITE}+', '', 'g')"
    return f"""
WITH g AS (SELECT *, chunk_index % 97 AS k FROM ({_chunk_sql(most)})),
b AS (SELECT doc_id, chunk_index AS place, CASE WHEN k = 41 THEN chunk_index + 1 ELSE chunk_index END AS chunk_index, CASE WHEN k = 53 THEN -1 ELSE paragraph_index END AS paragraph_index,
  CASE k WHEN 3 THEN ' ' || text WHEN 11 THEN '' WHEN 23 THEN text || repeat('x', 120) ELSE text END AS text, k, length(text) AS was FROM g),
c AS (SELECT *, CASE WHEN k = 31 THEN was + 1 ELSE length(text) END AS char_count FROM b),
-- two rows of one number have no order of their own: by number and then by place they have
o AS (SELECT *, lag(chunk_index, 1, -1) OVER w AS was_index, lag(paragraph_index, 1, 0) OVER w AS was_paragraph FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index, paragraph_index, text)),
v AS (SELECT doc_id, unnest(list_filter([CASE WHEN char_count > {most} THEN 'too_long' END, CASE WHEN text = '' THEN 'empty' END, CASE WHEN text <> trim(text) THEN 'unstripped' END,
  CASE WHEN char_count <> length(text) THEN 'wrong_count' END, CASE WHEN chunk_index <> was_index + 1 THEN 'index_gap' END, CASE WHEN paragraph_index < was_paragraph THEN 'paragraph_order' END], lambda x: x IS NOT NULL)) AS violation FROM o
  UNION ALL SELECT doc_id, 'text_changed' FROM (SELECT doc_id, {squeezed.replace("text", "string_agg(text, '' ORDER BY chunk_index, paragraph_index, text)")} AS got FROM c GROUP BY doc_id)
    FULL JOIN (SELECT doc_id, {squeezed} AS want FROM (SELECT doc_id, {_NARRATION} AS text FROM documents) WHERE {squeezed} <> '') USING (doc_id) WHERE got IS DISTINCT FROM want)
SELECT doc_id, violation, count(*) AS n FROM v GROUP BY ALL"""


_CHUNKS = _chunk_sql(300)
ORACLES = {
    "normalize_narration": f"SELECT doc_id, md5({_NARRATION}) AS text_md5 FROM documents",
    "normalize_prose": f"SELECT doc_id, md5({_PROSE}) AS text_md5 FROM documents",
    "paragraphs_narration": f"SELECT doc_id, paragraph_index::BIGINT AS paragraph_index, md5(text) AS text_md5 FROM ({_P_NARRATION})",
    "paragraphs_prose": f"SELECT doc_id, paragraph_index::BIGINT AS paragraph_index, md5(text) AS text_md5 FROM ({_P_PROSE})",
    "protected_spans": f"SELECT doc_id, unnest(x) AS span, generate_subscripts(x, 1) - 1 AS position FROM (SELECT doc_id, regexp_extract_all(text, '{_q(T.PROTECTED)}') AS x FROM documents)",
    "sentences_narration": _sentences(_P_NARRATION, _N_PIECES, _N_BREAKS),
    "sentences_prose": _sentences(_P_PROSE, _Q_PIECES, _Q_BREAKS),
    "chunk_corpus_narration": f"SELECT * EXCLUDE (text) FROM ({_CHUNKS})",
    "narration_demand": f"SELECT lang, source, count(*) AS chunks, sum(char_count)::BIGINT AS chars, round(sum(greatest(0.5, char_count / 14.0)) / 60, 4) AS minutes FROM ({_CHUNKS}) JOIN documents USING (doc_id) GROUP BY ALL",
    "chunk_size_stats": f"SELECT count(*) AS chunks, sum(char_count)::BIGINT AS total, min(char_count) AS smallest, max(char_count) AS largest, round(avg(char_count), 6) AS mean FROM ({_CHUNKS})",
    "chunk_corpus_merged": _merge_sql(_CHUNKS, 300),
    "chunk_audit_broken": _audit_sql(120),
    "chunk_audit": "SELECT 0::BIGINT AS doc_id, '' AS violation WHERE false",
    "speech_estimate": "SELECT conv_id, round(sum(greatest(0.5, length(text) / 14.0)), 6) AS seconds FROM conversations GROUP BY conv_id",
}
