"""WARC derivatives: metadata and plain-text conversion records of HTTP responses.

Input is a table of responses (:func:`page_responses` makes one from pages, :func:`read_warc`
from files). Each response yields two records that refer to it:

* ``metadata``: a JSON envelope with the source record's headers and the page's title and
  links, so that a reader needs not parse the page again;
* ``conversion``: the page's text, one block a line, with character references decoded.

Record ids are name-based on the source id and the record's kind, so reruns agree. Both keep
``WARC-Refers-To``, ``WARC-Target-URI``, ``WARC-Date`` and the source's payload digest, and bear
digests of their own blocks. A digest that the source record states is kept as it is; headers of a source
record stand in the metadata whole. No row meets another, nothing is
shuffled, and a skewed host or a very long page is no more than its own bytes. All is column expressions
but for character references, which tasks decode in Arrow batches.

A null or empty page gives an empty conversion and metadata without title and links; a null
address becomes an empty string. Rows that repeat give equal records. An empty table gives an
empty table. Other columns pass through :func:`page_responses` only if named in ``keep``.
"""

from __future__ import annotations

import codecs
import gzip
import io
import re
import zlib
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements whose content is no text, and tags that begin a line (fixed values).
HIDDEN = ("script", "style", "noscript", "template", "head")
LINES = ("address", "article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul")
#: Character references of common pages (fixed values), for the SQL beside the query; the operator decodes all that HTML has.
REFERENCES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#34;", '"'), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&bull;", "•"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&laquo;", "«"), ("&raquo;", "»"), ("&euro;", "€"), ("&amp;", "&"))
#: Those that pages may write without the semicolon (fixed values).
WITHOUT_SEMICOLON = ("amp", "lt", "gt", "quot", "copy", "reg", "middot", "laquo", "raquo")
DATE = "2024-01-01T00:00:00Z"
_HIDDEN_PATTERN = "(?is)<!--.*?-->|" + "|".join(rf"<{t}\b.*?</{t}\s*>" for t in HIDDEN)
_LINE_PATTERN = r"(?i)</?(" + "|".join(LINES) + r")\b[^>]*>"


def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unescape(t))


def plain_text(html: Column) -> Column:
    """The text of a page, a block a line, runs of white space as one space."""
    x = F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN_PATTERN, " ")
    x = F.regexp_replace(x, r"[\t\n\x0B\f\r ]+", " ")
    x = F.regexp_replace(x, _LINE_PATTERN, "\n")
    x = F.regexp_replace(x, r"<[a-zA-Z/!?][^>]*>", "")
    x = F.replace(x, F.lit("&nbsp;"), F.lit(" "))
    x = F.pandas_udf(_unescaped, "string")(x)  # of every row: asking first would work the expressions off twice
    x = F.regexp_replace(x, r"[ ]*\n[ \n]*", "\n")
    return F.regexp_replace(x, r"^[ \n]+|[ \n]+$", "")


def record_id(*parts: Column) -> Column:
    """A name-based identifier."""
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12)), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def page_responses(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = DATE, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pages as response records: ``source_id, target_uri, date, http_headers, payload``."""
    body, uri = F.coalesce(F.col(f"`{html}`"), F.lit("")), F.coalesce(F.col(f"`{url}`"), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"))
    return pages.select(F.col(f"`{page_id}`").alias("page_id"), *keep, record_id(F.lit("response"), F.col(f"`{page_id}`").cast("string"), uri).alias("source_id"), uri.alias("target_uri"), F.lit(date).alias("date"), head.alias("http_headers"), body.alias("payload"))


def derivatives(responses: DataFrame) -> DataFrame:
    """Two rows a response: ``page_id, record_type, record_id, refers_to, target_uri, date,
    content_type, content_length, block_digest, source_digest, block``."""
    own = digest(F.col("payload"))
    r = responses.withColumn("source_digest", F.coalesce("source_digest", own) if "source_digest" in responses.columns else own)
    if "error" in r.columns:
        r = r.where("error is null")
    headers = [F.col("source_headers").alias("Source-Headers")] if "source_headers" in r.columns else []
    title = F.coalesce(F.regexp_extract("payload", r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit(""))
    links = F.regexp_extract_all(F.col("payload"), F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    envelope = F.struct(
        F.col("source_id").alias("WARC-Refers-To"), F.col("target_uri").alias("WARC-Target-URI"), F.col("date").alias("WARC-Date"), F.col("source_digest").alias("WARC-Payload-Digest"),
        F.split("http_headers", "\r\n").alias("HTTP-Headers"), title.alias("Title"), links.alias("Links"), *headers,
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/json").alias("content_type"), F.to_json(envelope).alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain").alias("content_type"), plain_text(F.col("payload")).alias("block")),
    )
    r = r.select("page_id", "source_id", "target_uri", "date", "source_digest", F.explode(kinds).alias("k")).select("*", "k.*")
    return r.select(
        "page_id", "record_type", record_id(F.col("record_type"), F.col("source_id")).alias("record_id"), F.col("source_id").alias("refers_to"), "target_uri", "date", "content_type",
        F.octet_length("block").cast("long").alias("content_length"), digest(F.col("block")).alias("block_digest"), "source_digest", "block",
    )


def serialized(records: DataFrame) -> DataFrame:
    """``record_id, record``: each derivative as the text of a WARC record."""
    lines = [("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    head = F.concat(F.lit("WARC/1.1\r\n"), *[x for name, c in lines for x in (F.lit(f"{name}: "), F.col(c).cast("string"), F.lit("\r\n"))])
    return records.select("record_id", F.concat(head, F.lit("\r\n"), F.col("block"), F.lit("\r\n\r\n")).alias("record"))


def records(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes, str | None]]:
    """Place, header fields (names in lower case), block and error of each record of a WARC file.

    A record at a time is taken out of the file, gzipped or not. After a record whose length is no number, reading goes on at the
    next one; one that is cut short, or a broken gzip stream, ends it, with an error.
    """
    raw = io.BytesIO(content)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw
    at = 0
    try:
        while line := stream.readline(1 << 16):
            at = stream.tell() - len(line)
            if not line.startswith(b"WARC/"):
                continue
            fields, last = {}, None
            while (line := stream.readline(1 << 16)).strip(b"\r\n"):
                text = line.decode("utf-8", "replace").rstrip("\r\n")
                if text[0] in " \t" and last:
                    fields[last] += " " + text.strip()
                else:
                    name, _, value = text.partition(":")
                    last = name.strip().lower()
                    fields[last] = f"{fields[last]}, {value.strip()}" if last in fields else value.strip()
            size = fields.get("content-length", "")
            if not line:
                yield at, fields, b"", "header is cut short"
            elif not re.fullmatch(r"\d{1,18}", size, re.ASCII):
                yield at, fields, b"", "Content-Length is no number"
            else:
                block = stream.read(int(size))
                yield at, fields, block, None if len(block) == int(size) else "block is cut short"
    except (OSError, EOFError, zlib.error) as broken:
        yield at, {}, b"", f"broken gzip stream: {broken}"


_CHARSET = re.compile(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9._:-]+)", re.I)


def decoded(head: bytes, body: bytes) -> str:
    """A response's text in the character set that its header, else the head of its page names; UTF-8 without."""
    kind = next((line for line in head.split(b"\r\n") if line.lower().startswith(b"content-type:")), b"")
    named = _CHARSET.search(kind) or _CHARSET.search(body[:1024])
    try:
        name = codecs.lookup(named[1].decode("ascii")).name if named else "utf-8"
        # what pages call latin-1 is the Windows set, as browsers read it
        return body.decode("cp1252" if name in ("iso8859-1", "ascii") else name, "replace")
    except (LookupError, ValueError):
        return body.decode("utf-8", "replace")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files, gzipped or not, as :func:`derivatives` takes them.

    ``page_id`` is a hash of file and place, so ids of several files don't meet; ``source_headers`` has every
    field of the record, ``source_digest`` its payload digest if it states one. Broken records are rows with an
    ``error`` and no payload. A file is one task's work, as files of that format are cut to about a gigabyte.
    """
    names = "path", "place", "source_id", "target_uri", "date", "http_headers", "payload", "source_headers", "source_digest", "error"
    schema = "path string, place long, source_id string, target_uri string, date string, http_headers string, payload string, source_headers map<string,string>, source_digest string, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                for at, f, block, error in records(bytes(content)):
                    if error or f.get("warc-type") == "response":
                        head, _, body = block.partition(b"\r\n\r\n")
                        row = file, at, f.get("warc-record-id"), f.get("warc-target-uri", ""), f.get("warc-date"), head.decode("latin-1"), None if error else decoded(head, body), f, f.get("warc-payload-digest"), error
                        yield pd.DataFrame([row], columns=names)

    read = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)
    named = F.coalesce("source_id", record_id(F.lit("record"), F.col("path"), F.col("place").cast("string")))
    return read.withColumn("source_id", named).withColumn("page_id", F.xxhash64("path", "place")).drop("path", "place")
