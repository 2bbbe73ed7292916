"""WARC records derived from responses: linked metadata and plain-text conversions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
END = "\r\n"
# What is no text: scripts, styles and the like with their content, and comments.  Those
# that are not closed go on to the end, as they do for a browser; a head does not.
HIDDEN = (
    r"(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<noscript\b.*?(?:</noscript\s*>|\z)"
    r"|<template\b.*?(?:</template\s*>|\z)|<head\b.*?</head\s*>|<!--.*?(?:-->|\z)"
)
# Elements that start a new line.
BLOCKS = (
    r"(?i)</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|h[1-6]|table|tr|td|th|section|article|header|footer|nav|main|aside"
    r"|form|pre|blockquote|figure|title)\b[^>]*>"
)
TAGS = r"<[^>]*>"
# Characters by entity; the ampersand comes last.
ENTITIES = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&copy;": "©",
    "&middot;": "·", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…", "&amp;": "&",
}
LINKS = r'(?i)<a\s[^>]*?href="([^"]*)"'
TITLE = r"(?is)<title[^>]*>(.*?)</title"
# What would break or forge a line of a record's header or fields.
CONTROL = r"[\x00-\x1F\x7F]+"
DATE = "2024-01-01T00:00:00Z"
RESULTS = (
    "record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "content_length", "block",
    "block_digest", "payload_digest", "record",
)


def record_id(*parts: Column) -> Column:
    """A record id that depends on the parts alone."""
    digest = F.md5(F.concat_ws("|", *parts))
    groups = [F.substring(digest, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *groups), F.lit(">"))


def sha256(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))


def one_line(value: Column) -> Column:
    """A value without control characters, for a line of its own."""
    return F.regexp_replace(value, CONTROL, "")


def page_responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of a table (page_id, url, html): page_id, record_id, target_uri, date, block.

    A block is an HTTP message.  A null page is an empty body; a null address stays null.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.octet_length(body).cast("string"), F.lit(END + END),
    )
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    return pages.select(
        "page_id", record_id(F.lit("response"), page, F.coalesce("url", F.lit(""))).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit(date).alias("date"), F.concat(head, body).alias("block"),
    )


def plain_text(html: Column) -> Column:
    """The text of a page: blocks on lines of their own, runs of blanks as one, no empty lines.

    Tags that are not closed stay; so do entities other than ``ENTITIES``.
    """
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, " "), BLOCKS, "\n"), TAGS, "")
    for entity, character in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(character))
    text = F.regexp_replace(F.translate(text, "\t\r\x0b\x0c\xa0", "     "), " +", " ")
    return F.btrim(F.regexp_replace(text, " ?\n[ \n]*", "\n"), F.lit(" \n"))


def derivatives(responses: DataFrame) -> DataFrame:
    """A metadata and a conversion record of each response.

    The input has ``record_id``, ``target_uri``, ``date`` and ``block``, an HTTP
    message; its other columns stay, but for those with the name of a result.  The metadata record has the status and header
    lines of the source, the digest of its payload, the title and the links; the
    conversion record has the text.  Both refer to the response by ``refers_to``.

    Returns, besides the other columns: ``record_type``, ``record_id``, ``refers_to``,
    ``target_uri``, ``date``, ``content_type``, ``content_length``, ``block``,
    ``block_digest``, ``payload_digest`` (of the source's body) and ``record``, the
    whole record as text, which is ready to be written.

    A message without an empty line has headers alone and an empty body.  A null block
    is an empty message.  A null address leaves out its header.  Control characters in an
    address, a link, the title or a header line are left out of the lines made of them.  Repeated responses
    have equal derivatives, since ids depend on the response's id.  An empty table
    gives an empty result.  All is built-in functions on single rows; each step is
    pinned by a generator, so that a page is converted once.
    """
    own = ["record_id", "target_uri", "date", "block"]
    rest = [c for c in responses.columns if c not in (*own, *RESULTS)]
    source = responses.select(
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest") if rest else F.lit(None).alias("rest"),
        F.col("record_id").alias("refers_to"), "target_uri", "date",
        F.coalesce(F.col("block"), F.lit("")).alias("message"),
    )
    head = F.substring_index("message", END + END, 1)
    source = source.select("rest", "refers_to", "target_uri", "date", F.inline(F.array(F.struct(
        head.alias("head"), F.substr("message", F.char_length(head) + F.lit(5)).alias("body"),
    ))))
    title = F.btrim(F.regexp_replace(F.regexp_extract("body", TITLE, 1), r"\s+", " "))
    links = F.regexp_extract_all("body", F.lit(LINKS), F.lit(1))
    digest = sha256(F.col("body"))
    fields = F.concat(
        F.concat_ws("", F.transform(F.split("head", END), lambda line: F.concat(F.lit("source-header: "), one_line(line), F.lit(END)))),
        F.lit("source-payload-digest: "), digest, F.lit(END),
        F.when(title != "", F.concat(F.lit("title: "), one_line(title), F.lit(END))).otherwise(""),
        F.concat_ws("", F.transform(links, lambda link: F.concat(F.lit("outlink: "), one_line(link), F.lit(END)))),
    )
    records = F.array(
        _derived("metadata", "application/warc-fields", fields, digest),
        _derived("conversion", "text/plain; charset=utf-8", plain_text(F.col("body")), digest),
    )
    blocks = source.select("rest", "refers_to", "target_uri", "date", F.inline(records))
    digests = blocks.select("*", F.inline(F.array(F.struct(
        F.octet_length("block").cast("long").alias("content_length"), sha256(F.col("block")).alias("block_digest"),
    ))))
    lines = {
        "WARC-Type": "record_type", "WARC-Record-ID": "record_id", "WARC-Refers-To": "refers_to",
        "WARC-Target-URI": "target_uri", "WARC-Date": "date", "WARC-Block-Digest": "block_digest",
        "Content-Type": "content_type", "Content-Length": "content_length",
    }
    header = F.concat(F.lit(VERSION + END), *[
        F.coalesce(F.concat(F.lit(f"{name}: "), one_line(F.col(c).cast("string")), F.lit(END)), F.lit(""))
        for name, c in lines.items()
    ])
    return digests.select(
        *[F.col("rest")[c].alias(c) for c in rest], *RESULTS[:-1],
        F.concat(header, F.lit(END), F.col("block"), F.lit(END + END)).alias("record"),
    )


def _derived(kind: str, content_type: str, block: Column, payload: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("record_type"),
        record_id(F.lit(kind), F.coalesce("refers_to", F.lit(""))).alias("record_id"),
        F.lit(content_type).alias("content_type"), block.alias("block"), payload.alias("payload_digest"),
    )
