"""Content-addressed web archive: payload bytes once per verified strong digest, exact record headers beside them.

A record is a WARC header, a block and two line ends. The block of a response is an HTTP header and the payload, that of a revisit
the HTTP header alone, so what differs between equal payloads is all in the headers table, and joining it with the payloads
gives the exact bytes of every record back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, sliced, stored

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:archive:page:"


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing if the value is null; line breaks in values are escaped."""
    plain = F.regexp_replace(F.regexp_replace(value.cast("string"), "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(name + ": "), plain, F.lit(CRLF)), F.lit(""))


def write_archive(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 1000, date: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Writes (headers, payloads) tables in the shared folder and returns them as read back.

    headers: id, address, header (exact bytes of the record up to its payload). payloads: address (SHA-256), payload.
    A record whose payload (null: empty) has `least` bytes or more and equals that of a record with a larger id is a
    revisit of the one with the largest id; rows that share the largest id, or lack ids, are responses. Record ids are made of the rows'
    ids, so repeated ids give repeated record ids. `date` (ISO 8601, UTC) is the time of writing if not given. The addresses of a payload that
    very many rows share are split at run time in the join that gives them its facts; these rows hold headers only.
    """
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(quoted(id_col).alias("id"), quoted(url_col).alias("url"), F.coalesce(quoted(body_col).cast("binary"), F.lit(b"")).alias("payload"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.length("payload").cast("string"), F.lit(CRLF + CRLF))
    rows = rows.select("id", "url", "payload", F.sha2("payload", 256).alias("address"))
    mark = F.xxhash64("payload")
    held = rows.groupBy("address").agg(
        F.first("payload").alias("payload"), F.max("id").alias("holder"), F.min(mark).alias("low"), F.max(mark).alias("high")
    )
    same = F.when(F.col("low") == F.col("high"), F.col("payload")).otherwise(F.raise_error(F.lit("unequal payloads under one digest")))
    block = lambda tail: F.sha2(F.concat(F.encode(http, "UTF-8"), tail), 256)
    held = held.select("address", same.alias("payload"), "holder", http.alias("http"), block(F.lit(b"")).alias("revisit_block"), block(F.col("payload")).alias("block"))
    held = held.withColumns({"bytes": F.length("payload").cast("long"), "sha1": F.sha1("payload")})
    payloads = stored(held, "payloads")
    heads = rows.select("id", "url", "address").join(payloads.drop("payload"), "address")
    revisit = F.coalesce((F.col("bytes") >= least) & (F.col("id") != F.col("holder")), F.lit(False))
    name = lambda c: F.concat(F.lit(f"<{_URN}"), c.cast("string"), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", F.coalesce(name(F.col("id")), F.lit(f"<{_URN}>"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.when(revisit, F.col("revisit_block")).otherwise(F.col("block")))),
        _line("WARC-Profile", F.when(revisit, PROFILE)),
        _line("WARC-Refers-To", F.when(revisit, name(F.col("holder")))),
        F.lit("Content-Type: application/http;msgtype=response" + CRLF),
        _line("Content-Length", F.length("http") + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))),
        F.lit(CRLF),
        F.col("http"),
    )
    headers = stored(heads.select("id", "address", F.encode(header, "UTF-8").alias("header")), "headers")
    return headers, payloads.select("address", "payload")


def _checked(payloads: DataFrame) -> DataFrame:
    """(address, payload); a payload whose bytes don't have the digest of its address is an error."""
    good = F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(F.raise_error(F.lit("payload and digest differ")))
    return payloads.select("address", good.alias("payload"))


def _joined(headers: DataFrame, checked: DataFrame, at_revisit: list[str]) -> DataFrame:
    """Each record's bytes, and beside those of a revisit, which don't hold its payload, the columns `at_revisit` of the payload's row."""
    is_revisit = F.instr(F.col("header").cast("string"), f"{CRLF}WARC-Type: revisit{CRLF}") > 0
    record = F.concat("header", F.when(is_revisit, F.lit(b"")).otherwise(F.col("payload")), F.lit(b"\r\n\r\n"))
    return headers.join(checked, "address").select("id", "address", record.alias("record"), *(F.when(is_revisit, F.col(c)).alias(c) for c in at_revisit))


def reconstructed(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """(id, address, record, payload): the exact bytes of each record, and for revisits, which don't hold it, the full payload.

    A payload whose bytes don't have the digest of its address is an error.
    """
    return _joined(headers, _checked(payloads), ["payload"])


def parsed_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields by lower-case name, block) of a record's bytes; a length or digest that doesn't hold is an error."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split(CRLF)
    fields = {n.lower(): v for n, _, v in (line.partition(": ") for line in lines)}
    block = rest[: int(fields["content-length"])]
    if first != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or fields["warc-block-digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
        raise ValueError(f"damaged record {fields.get('warc-record-id')}")
    return fields, block


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in sliced(batches):
        rows = []
        for record, full_sha1, full_bytes in zip(batch["record"], batch["sha1"], batch["bytes"]):
            fields, block = parsed_record(record)
            http, _, payload = block.partition(b"\r\n\r\n")
            kind, refers = fields["warc-type"], fields.get("warc-refers-to")
            digest, size = (full_sha1, int(full_bytes)) if kind == "revisit" else (hashlib.sha1(payload).hexdigest(), len(payload))
            if fields["warc-payload-digest"] != "sha1:" + digest or int(http.rpartition(b": ")[2]) != size:
                raise ValueError(f"payload of {fields['warc-record-id']} has another length or digest than stated")
            rows.append((kind, refers and refers[len(_URN) + 1 : -1], fields["warc-date"], size, digest))
        yield pd.concat([batch[["id"]], pd.DataFrame(rows, columns=["record_type", "refers_to", "date", "payload_bytes", "payload_digest"])], axis=1)


def read_archive(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """What a reader finds in the records' bytes: id, record_type, refers_to (id as string), date, payload_bytes, payload_digest.

    Lengths and both digests are computed from the bytes and compared with the headers; a difference is an error. The bytes that revisits
    refer to are read and digested once per payload, however many they are; a revisit carries the length and digest alone.
    """
    kind = headers.schema["id"].dataType.simpleString()
    checked = _checked(payloads).withColumns({"sha1": F.sha1("payload"), "bytes": F.length("payload").cast("long")})
    records = _joined(headers, checked, ["sha1", "bytes"]).select(F.col("id").cast("string").alias("id"), "record", "sha1", "bytes")
    found = records.mapInPandas(_read, "id string, record_type string, refers_to string, date string, payload_bytes long, payload_digest string")
    return found.withColumn("id", F.col("id").cast(kind))


def archived_pages(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """The archive of pages, written and read back, as one row per page of what a reader finds. Other columns are left out."""
    records = read_archive(*write_archive(pages, id_col, url_col, body_col))
    kind = pages.schema[id_col].dataType.simpleString()
    return records.select(
        F.col("id").alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )
