"""WARC derivatives: metadata and plain-text conversion records of responses.

Defined cases: a response without payload (null or empty) gives a conversion with an empty
block; a null uri or header block is written as empty; equal responses give equal records, so
repeated rows repeat; an empty table gives no records. Payloads are taken whole. Only the
columns named here are read, so others never clash.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HIDDEN = re.compile(r"<!--.*?-->|<(script|style|template|noscript)\b[^>]*>.*?</\1\s*>", re.I | re.S)
_BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|header|footer|nav|"
                    r"title|head|body|html|pre|blockquote|hr|td|th|dd|dt|dl)\b[^>]*>", re.I)
_TAG = re.compile(r"<[/!?a-zA-Z][^>]*>")
_SPACES = re.compile(r"[ \t\r\f\v\xa0]+")
_LINES = re.compile(r" ?\n[ \n]*")
_TITLE = re.compile(r"<title[^>]*>(.*?)</title\s*>", re.I | re.S)
_LINK = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

RECORD = T.StructType([T.StructField(n, T.StringType()) for n in (
    "kind", "record_id", "refers_to", "target_uri", "date", "content_type", "block_digest",
    "source_digest", "block", "record")] + [T.StructField("length", T.LongType())])


def plain_text(payload: str) -> str:
    """Visible text of a page: a line for each block, white space collapsed."""
    text = _HIDDEN.sub(" ", payload).replace("\n", " ")
    text = html.unescape(_TAG.sub("", _BREAK.sub("\n", text)))
    return _LINES.sub("\n", _SPACES.sub(" ", text)).strip()


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(*parts: str) -> str:
    name = hashlib.sha1("\n".join(parts).encode("utf-8", "surrogatepass")).hexdigest()
    return f"<urn:uuid:{name[:8]}-{name[8:12]}-5{name[13:16]}-a{name[17:20]}-{name[20:32]}>"


def _line(value: str | None) -> str:
    return re.sub(r"[\r\n]+", " ", value or "")


def _record(kind: str, response: dict, content_type: str, block: str) -> dict:
    body, source = block.encode("utf-8", "surrogatepass"), digest((response["payload"] or "").encode("utf-8", "surrogatepass"))
    own = record_id(kind, response["record_id"] or "")
    fields = {
        "WARC-Type": kind, "WARC-Record-ID": own, "WARC-Refers-To": _line(response["record_id"]),
        "WARC-Target-URI": _line(response["target_uri"]), "WARC-Date": _line(response["date"]),
        "WARC-Block-Digest": digest(body), "Content-Type": content_type, "Content-Length": str(len(body)),
    }
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return {
        "kind": kind, "record_id": own, "refers_to": response["record_id"], "target_uri": response["target_uri"],
        "date": response["date"], "content_type": content_type, "block_digest": fields["WARC-Block-Digest"],
        "source_digest": source, "block": block, "record": head + block + "\r\n\r\n", "length": len(body),
    }


def derivatives(response: dict) -> list[dict]:
    """The metadata and the conversion record of one response."""
    payload, source_headers = response["payload"] or "", response["http_headers"] or ""
    title = _TITLE.search(payload)
    lines = [f"source-payload-digest: {digest(payload.encode('utf-8', 'surrogatepass'))}",
             f"source-payload-length: {len(payload.encode('utf-8', 'surrogatepass'))}"]
    for header in source_headers.splitlines():
        if header.strip():
            lines.append(f"source-header: {_line(header.strip())}")
    if title:
        lines.append(f"title: {_line(html.unescape(title[1]).strip())}")
    lines += [f"outlink: {_line(html.unescape(a or b or c).strip())}" for a, b, c in _LINK.findall(payload)]
    return [_record("metadata", response, "application/warc-fields", "\r\n".join(lines) + "\r\n"),
            _record("conversion", response, "text/plain; charset=UTF-8", plain_text(payload))]


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Crawled pages (page_id, url, html) as response records with a minimal HTTP head."""
    body = F.coalesce("html", F.lit(""))
    name = F.sha1(F.concat_ws("\n", F.col("page_id").cast("string"), "url", "html").cast("binary"))
    part = lambda start, size: F.substring(name, start, size)
    return pages.select(
        F.col("page_id"),
        F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-a"),
                 part(18, 3), F.lit("-"), part(21, 12), F.lit(">")).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit(date).alias("date"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                 F.octet_length(body).cast("string"), F.lit("\r\n")).alias("http_headers"),
        F.col("html").alias("payload"))


def build_derivatives(source: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two records for each response: metadata and conversion, linked by refers_to.

    ``source`` has record_id, target_uri, date, http_headers and payload; the columns named in
    ``keep`` stay beside those of the records. ``record`` is the whole record as written.
    """
    fields = ("record_id", "target_uri", "date", "http_headers", "payload")
    kept = [source.schema[c] for c in keep]

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch.iloc[start:start + 500]
                rows = []
                for row in part.to_dict("records"):
                    response = {f: None if pd.isna(row[f"__{f}"]) else row[f"__{f}"] for f in fields}
                    rows += [{k: row[k] for k in keep} | r for r in derivatives(response)]
                yield pd.DataFrame(rows, columns=[*keep, *RECORD.names])

    named = source.select(*keep, *(F.col(f).cast("string").alias(f"__{f}") for f in fields))
    return named.mapInPandas(build, T.StructType([*kept, *RECORD.fields]))


def write_warc(records: DataFrame, folder: str) -> None:
    """Records as gzipped WARC files, one per partition, through Spark's own writer."""
    ended = F.expr("substring(record, 1, length(record) - 4)")  # the writer ends each record
    records.select(ended.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(folder)
