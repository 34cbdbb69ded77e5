r"""WARC derivatives: response records into linked metadata and plain-text conversion records.

All of it is DataFrame functions on one row at a time: a response becomes two rows in the task that read it.

``responses`` describes raw pages as response records; ``derive`` takes such records from anywhere. Record ids are
``urn:uuid`` names over a digest, so that they are the same on every run, and both derivatives name their source in
WARC-Refers-To, WARC-Refers-To-Target-URI and in the payload digest they carry. Digests are sha1 in lower-case hex. Blocks
are UTF-8 and Content-Length counts their bytes.

Text of a page: scripts, styles, comments and head are left out, the first three up to the page's end where they aren't closed;
block tags end a line, other tags vanish, a tag that the page breaks off in too; ``<`` before a blank or a digit is text. Then
entities are decoded once, from left to right, those of HTML 4 by name and all by number; others stay as they are, and nbsp is a
blank. Blanks are run together and empty lines dropped. A head that isn't closed is text.

Outlinks are the values of ``href`` of ``a`` tags, in either quotes or none, each once.

Both derivatives have the date of their source as WARC-Refers-To-Date and as WARC-Date their own, by default the same one.

Defined results: a null html is an empty payload, a null date is UNDATED, a null url an empty target, line breaks leave a url (they would end its header), a null page_id the empty string in names;
equal pages that repeat get equal records each; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound

#: Tags that end a line.
BLOCK_TAGS = "address article aside blockquote br dd div dl dt footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split()
#: The entities of HTML 4 by name.
NAMED = {name: " " if name == "nbsp" else chr(point) for name, point in sorted(name2codepoint.items())} | {"apos": "'"}
ENTITY = "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"

#: The date of records whose source has none.
UNDATED = "1970-01-01T00:00:00Z"

DROPPED = r"(?is)<script(\s[^>]*)?>.*?(</script\s*>|\z)|<style(\s[^>]*)?>.*?(</style\s*>|\z)|<!--.*?(-->|\z)|<head(\s[^>]*)?>.*?</head\s*>"
BLOCK = rf"(?i)</?({'|'.join(BLOCK_TAGS)})(\s[^>]*)?/?>"
TAG = r"<[a-zA-Z/!?][^>]*(>|\z)"
TITLE = r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>"
LANG = r"(?i)<html(?:\s[^>]*)?\slang\s*=\s*[\"']?([A-Za-z0-9_-]*)"
#: The value of an attribute with its quotes.
LINK = r"(?i)<a(?:\s[^>]*?)?\shref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)"


def sha1(text: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.sha1(F.encode(text, "UTF-8")))


def name(*parts: Column) -> Column:
    """A urn:uuid over the md5 of the parts."""
    h = F.md5(F.encode(F.concat_ws("|", *parts), "UTF-8"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def character(point: Column) -> Column:
    """The character of a code point; null for what is none."""
    real = (point > 0) & (point < 0x110000) & ~point.between(0xD800, 0xDFFF)
    return F.when(real, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))


def decoded(text: Column) -> Column:
    """``text`` with its entities decoded; what an entity decodes to isn't decoded again."""
    names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])

    def one(piece: Column) -> Column:
        def known(name: Column) -> Column:
            number = F.when(F.lower(F.substring(name, 2, 1)) == "x", F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7)).try_cast("long")
            char = F.when(name.startswith("#"), character(number)).otherwise(names[name])
            return F.coalesce(F.concat(char, F.substring(piece, F.length(name) + 2, F.length(piece))), F.concat(F.lit("&"), piece))

        return bound(F.regexp_extract(piece, ENTITY, 1), known)

    # the pieces are made once: what they are cut from may be costly
    return bound(F.split(text, "&", -1), lambda pieces: F.concat(pieces[0], F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), one), "")))


def unquoted(value: Column) -> Column:
    return F.when(value.rlike("^[\"']"), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def plain_text(html: Column) -> Column:
    text = F.regexp_replace(html, DROPPED, " ")
    text = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), BLOCK, "\n")
    text = decoded(F.regexp_replace(text, TAG, ""))
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]{2,}|\t", " "), r" ?\n[ \n]*", "\n")
    return F.btrim(text, F.lit(" \n"))


def responses(pages: DataFrame, date: Column | None = None) -> DataFrame:
    """(page_id, record_id, date, target_uri, source_headers, payload, payload_digest) for pages (page_id, url, html);
    ``date`` is when they were fetched, as WARC writes it."""
    payload, url = F.coalesce("html", F.lit("")), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", "")
    fetched = F.coalesce(F.lit(None) if date is None else date, F.lit(UNDATED))
    rows = pages.select("page_id", url.alias("target_uri"), payload.alias("payload"), fetched.alias("date"))
    rows = rows.withColumn("payload_digest", sha1(F.col("payload")))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit("\r\n"))
    return rows.select("page_id", name(F.lit("response"), page, F.col("target_uri"), F.col("payload_digest")).alias("record_id"), "date", "target_uri", headers.alias("source_headers"), "payload", "payload_digest")


def derive(responses: DataFrame, date: Column | None = None) -> DataFrame:
    """Two rows for each response: its metadata record and its conversion record, made at ``date``.

    (page_id, warc_type, record_id, refers_to, target_uri, content_type, content_length, block_digest, source_digest,
    source_headers, header, block)"""
    html, source_date = F.coalesce("payload", F.lit("")), F.coalesce("date", F.lit(UNDATED))
    links = F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(LINK), 1), lambda x: decoded(unquoted(x))))
    fields = F.concat_ws(
        "\r\n",
        F.concat(F.lit("title: "), F.trim(F.regexp_replace(decoded(F.regexp_extract(html, TITLE, 1)), r"\s+", " "))),
        F.concat(F.lit("language: "), F.regexp_extract(html, LANG, 1)),
        F.concat(F.lit("source-content-length: "), F.octet_length(html).cast("string")),
        F.transform(links, lambda x: F.concat(F.lit("outlink: "), F.regexp_replace(x, r"[\r\n]+", ""))),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), F.concat(fields, F.lit("\r\n")).alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(html).alias("block")),
    )
    rows = responses.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", F.col("payload_digest").alias("source_digest"), "source_headers", source_date.alias("source_date"), (source_date if date is None else F.coalesce(date, F.lit(UNDATED))).alias("made"), F.explode(kinds).alias("k"))
    rows = rows.select("page_id", "k.warc_type", name(F.col("k.warc_type"), F.col("refers_to")).alias("record_id"), "refers_to", "target_uri", "k.content_type", F.octet_length("k.block").cast("long").alias("content_length"), sha1(F.col("k.block")).alias("block_digest"), "source_digest", "source_headers", "source_date", "made", F.col("k.block").alias("block"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("warc_type"), F.lit("\r\nWARC-Record-ID: "), F.col("record_id"),
        F.lit("\r\nWARC-Date: "), F.col("made"),
        F.lit("\r\nWARC-Refers-To: "), F.col("refers_to"), F.lit("\r\nWARC-Refers-To-Target-URI: "), F.col("target_uri"), F.lit("\r\nWARC-Refers-To-Date: "), F.col("source_date"),
        F.lit("\r\nWARC-Target-URI: "), F.col("target_uri"), F.lit("\r\nWARC-Block-Digest: "), F.col("block_digest"),
        F.lit("\r\nWARC-Source-Payload-Digest: "), F.col("source_digest"), F.lit("\r\nContent-Type: "), F.col("content_type"),
        F.lit("\r\nContent-Length: "), F.col("content_length").cast("string"), F.lit("\r\n"),
    )
    return rows.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "content_type", "content_length", "block_digest", "source_digest", "source_headers", header.alias("header"), "block")


def record(derived: DataFrame) -> DataFrame:
    """The records as they stand in a WARC file: header, empty line, block, two empty lines."""
    return derived.select("record_id", F.concat("header", F.lit("\r\n"), "block", F.lit("\r\n\r\n")).alias("record"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def _uuid(h: str) -> str:
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


_NAMES = "MAP {" + ", ".join(f"'{n}': '{c.replace(chr(39), chr(39) * 2)}'" for n, c in NAMED.items()) + "}"
_FOUND = f"regexp_extract(p, '{ENTITY}', 1)"
_POINT = f"CASE WHEN {_FOUND} LIKE '#x%' OR {_FOUND} LIKE '#X%' THEN ('0x' || substr({_FOUND}, 3))::BIGINT ELSE substr({_FOUND}, 2)::BIGINT END"
_CHAR = f"CASE WHEN {_FOUND} = '' THEN NULL WHEN {_FOUND} LIKE '#%' THEN CASE WHEN {_POINT} BETWEEN 1 AND 55295 OR {_POINT} BETWEEN 57344 AND 1114111 THEN chr(({_POINT})::INT) END ELSE names[{_FOUND}] END"


def _decoded(x: str) -> str:
    pieces = f"string_split({x}, '&')"
    return f"{pieces}[1] || array_to_string(list_transform({pieces}[2:], lambda p: coalesce({_CHAR} || substr(p, length({_FOUND}) + 2), '&' || p)), '')"


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_BARE = "CASE WHEN regexp_matches(x, '^[\"'']') THEN substr(x, 2, length(x) - 2) ELSE x END"
_LINKS = f"list_transform(regexp_extract_all(payload, {_text(LINK)}, 1), lambda x: {_decoded(_BARE)})"
_KEPT = f"regexp_replace(payload, {_text(DROPPED)}, ' ', 'g')"
_LINES = f"regexp_replace(regexp_replace({_KEPT}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), {_text(BLOCK)}, chr(10), 'g')"
ORACLE = f"""
WITH known AS (SELECT {_NAMES} AS names), source AS (
  SELECT page_id, regexp_replace(coalesce(url, ''), '[\r\n]+', '', 'g') AS target_uri, coalesce(html, '') AS payload, 'sha1:' || sha1(coalesce(html, '')) AS source_digest FROM pages
), named AS (
  SELECT *, md5('response|' || coalesce(page_id::VARCHAR, '') || '|' || target_uri || '|' || source_digest) AS h,
    'HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ' || strlen(payload)::VARCHAR || '\r\n' AS source_headers,
    {_decoded(f"regexp_extract(payload, {_text(TITLE)}, 1)")} AS title, regexp_extract(payload, {_text(LANG)}, 1) AS lang,
    {_LINKS} AS hrefs,
    {_decoded(f"regexp_replace({_LINES}, {_text(TAG)}, '', 'g')")} AS t
  FROM source, known
), both_kinds AS (
  SELECT page_id, {_uuid('h')} AS refers_to, target_uri, source_digest, source_headers,
    unnest([
      {{'kind': 'metadata', 'content_type': 'application/warc-fields', 'block': 'title: ' || trim(regexp_replace(title, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) || '\r\nlanguage: ' || lang || '\r\nsource-content-length: ' || strlen(payload)::VARCHAR
        || coalesce('\r\n' || array_to_string(list_transform(list_filter(hrefs, lambda x, i: list_position(hrefs, x) = i), lambda x: 'outlink: ' || regexp_replace(x, '[\r\n]+', '', 'g')), '\r\n'), '') || '\r\n'}},
      {{'kind': 'conversion', 'content_type': 'text/plain; charset=utf-8', 'block': regexp_replace(regexp_replace(regexp_replace(t, '[ \\t]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')}}
    ]) AS k
  FROM named
), ids AS (
  SELECT page_id, k.kind AS warc_type, md5(k.kind || '|' || refers_to) AS h, refers_to, target_uri, k.content_type AS content_type, strlen(k.block)::BIGINT AS content_length,
    'sha1:' || sha1(k.block) AS block_digest, source_digest, source_headers, k.block AS block
  FROM both_kinds
), records AS (SELECT *, {_uuid('h')} AS record_id FROM ids)
SELECT page_id, warc_type, record_id, refers_to, target_uri, content_type, content_length, block_digest, source_digest, source_headers,
  'WARC/1.1\r\nWARC-Type: ' || warc_type || '\r\nWARC-Record-ID: ' || record_id || '\r\nWARC-Date: {UNDATED}\r\nWARC-Refers-To: ' || refers_to || '\r\nWARC-Refers-To-Target-URI: ' || target_uri
  || '\r\nWARC-Refers-To-Date: {UNDATED}'
  || '\r\nWARC-Target-URI: ' || target_uri || '\r\nWARC-Block-Digest: ' || block_digest || '\r\nWARC-Source-Payload-Digest: ' || source_digest
  || '\r\nContent-Type: ' || content_type || '\r\nContent-Length: ' || content_length::VARCHAR || '\r\n' AS header, block
FROM records
"""
