"""A content-addressed WARC archive.

Two tables in the shared folder: *payloads* holds every distinct payload once, compressed,
under its SHA-256; *headers* holds for each record its exact header bytes, the
payload's digest and whether it is a revisit.  Records are put together again by joining the two: a
response with its payload, which is read, decompressed and verified once (a mismatch is an error), and a revisit,
which has no block, with the payload's digest alone.  All joins are between tables, the side of the payloads with
one row per digest, so that adaptive execution may split the records of a payload that many pages have.

Equal payloads keep one response record (the largest page id); the others are revisit
records without a block, which name the response and the payload's digest.

Defined results: a null html is an empty payload; empty payloads are equal; pages that repeat an
id give a record each, all of the same type; a null id is never a response if an equal payload has an id;
any 64-bit id is exact; other columns are ignored; an empty table yields an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Records carry no time of capture; a fixed one keeps archives reproducible.
DATE = "1970-01-01T00:00:00Z"
REVISIT = b"\r\nWARC-Type: revisit\r\n"


@dataclass
class Archive:
    payloads: DataFrame  # digest, payload (zstd)
    headers: DataFrame  # digest, header, revisit


def payload_digest(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _id(text: str):
    own = text[len("<urn:page:") : -1]
    return None if own == "none" else int(own)


def header(page_id, url, sha1: str, n: int, response) -> bytes:
    """Header bytes, up to and with the empty line."""
    page_id, response = (None if pd.isna(x) else int(x) for x in (page_id, response))
    revisit = page_id != response
    target = "".join(c for c in (url or "") if c not in "\r\n")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{sha1}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(response)}"]
    lines.append(f"Content-Length: {0 if revisit else n}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and block of a record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:n]


def _describe(batches):
    for pdf in batches:
        raw = [x.encode() for x in pdf["html"]]
        yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "digest": [hashlib.sha256(x).digest() for x in raw], "sha1": [payload_digest(x) for x in raw], "n": [len(x) for x in raw]})


def _payloads(batches):
    seen, pack = set(), zstandard.ZstdCompressor(level=3)
    for pdf in batches:
        out = []
        for x in pdf["html"]:
            raw = x.encode()
            digest = hashlib.sha256(raw).digest()
            if digest not in seen:
                seen.add(digest)
                out.append((digest, pack.compress(raw)))
        yield pd.DataFrame(out, columns=["digest", "payload"])


def _headers(batches):
    for pdf in batches:
        made = [header(*x) for x in zip(pdf["page_id"], pdf["url"], pdf["sha1"], pdf["n"], pdf["response"], strict=True)]
        yield pd.DataFrame({"digest": pdf["digest"], "header": made, "revisit": [REVISIT in x for x in made]})


def write(spark: SparkSession, pages: DataFrame) -> Archive:
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    made = common.keep(spark, common.frames(rows, _describe, "page_id long, url string, digest binary, sha1 string, n long"), "pages")
    chosen = common.keep(spark, made.groupBy("digest").agg(F.max("page_id").alias("response")), "responses")
    headers = common.keep(spark, common.frames(made.join(chosen, "digest"), _headers, "digest binary, header binary, revisit boolean"), "headers")
    payloads = common.keep(spark, common.frames(rows, _payloads, "digest binary, payload binary").dropDuplicates(["digest"]), "payloads")
    common.forget(spark, made, chosen)
    return Archive(payloads, headers)


def _read(payload: bytes, digest: bytes) -> bytes:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    if hashlib.sha256(raw).digest() != digest:
        raise ValueError("a stored payload doesn't have its digest")
    return raw


def _records(batches):
    for pdf in batches:
        raw = [b"" if p is None else _read(p, d) for p, d in zip(pdf["payload"], pdf["digest"], strict=True)]
        yield pd.DataFrame({"record": [h + x + b"\r\n\r\n" for h, x in zip(pdf["header"], raw, strict=True)], "digest": pdf["digest"]})


def _responses(archive: Archive) -> DataFrame:
    return archive.headers.filter("NOT revisit").join(archive.payloads, "digest").select("digest", "header", "payload")


def _revisits(archive: Archive) -> DataFrame:
    return archive.headers.filter("revisit").select("digest", "header", F.lit(None).cast("binary").alias("payload"))


def records(archive: Archive) -> DataFrame:
    """record (its original bytes) and digest; only responses read a payload."""
    return common.frames(_responses(archive).unionByName(_revisits(archive)), _records, "record binary, digest binary")


def _facts(batches):
    """Of each payload, from its stored bytes."""
    for pdf in batches:
        raw = [_read(*x) for x in zip(pdf["payload"], pdf["digest"], strict=True)]
        yield pd.DataFrame({"digest": pdf["digest"], "payload_bytes": list(map(len, raw)), "payload_digest": list(map(payload_digest, raw))})


SUMMARY = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _summaries(batches, kind: str):
    """A response is told by its block, a revisit, which has none, by its payload's facts."""
    for pdf in batches:
        out = []
        made = next(_records([pdf]))["record"]
        facts = zip(pdf["payload_bytes"], pdf["payload_digest"], strict=True) if kind == "revisit" else [None] * len(pdf)
        for record, fact in zip(made, facts, strict=True):
            fields, block = parse(record)
            n, sha1 = fact or (len(block), payload_digest(block))
            if fields["WARC-Type"] != kind or fields["WARC-Payload-Digest"] != f"sha1:{sha1}" or (kind == "revisit" and block):
                raise ValueError("a record doesn't agree with its payload")
            out.append((_id(fields["WARC-Record-ID"]), n, sha1, kind, _id(fields["WARC-Refers-To"]) if kind == "revisit" else None))
        got = pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], dtype=object)
        yield got


def summaries(spark: SparkSession, archive: Archive) -> DataFrame:
    """Per record, told from its own bytes and its payload's: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Records are read where they are put together: a payload travels once.
    """
    facts = common.keep(spark, common.frames(archive.payloads, _facts, "digest binary, payload_bytes long, payload_digest string"), "facts")
    responses = common.frames(_responses(archive), lambda it: _summaries(it, "response"), SUMMARY)
    revisits = common.frames(_revisits(archive).join(facts, "digest"), lambda it: _summaries(it, "revisit"), SUMMARY)
    return responses.unionByName(revisits)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the archive, reads it back, and tells each record's facts."""
    return summaries(spark, write(spark, common.table(spark, sf_dir, "pages")))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, max(page_id) OVER (PARTITION BY h) AS r,
             list_reduce(list_transform(string_split(sha1(h), ''), lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (strpos('0123456789abcdef', c) - 1) + 1, 4)), lambda a, b: a || b) AS bits
      FROM p)
SELECT page_id, n AS payload_bytes,
       list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + 16 * CAST(bits[5 * i + 1] AS INT) + 8 * CAST(bits[5 * i + 2] AS INT) + 4 * CAST(bits[5 * i + 3] AS INT) + 2 * CAST(bits[5 * i + 4] AS INT) + CAST(bits[5 * i + 5] AS INT) AS BIGINT), 1)), lambda a, b: a || b) AS payload_digest,
       CASE WHEN page_id = r THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> r THEN r END AS refers_to
FROM d
"""
