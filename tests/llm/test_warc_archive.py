import base64
import hashlib

import pytest
import zstandard
from lodestone.llm import warc_archive as wa
from pyspark.sql import functions as F

ROWS = [(1, "http://a/\r\nX: 1", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "u", "x" * 100_000), (5, "u", "x" * 100_000), (None, "n", "only"), (None, "n", "<p>é</p>"), (6, "u", "\r\n\r\nWARC-Type: revisit\r\n")]


@pytest.fixture
def archive(spark):
    return wa.write(spark, spark.createDataFrame([(*r, "z") for r in ROWS], "page_id long, url string, html string, digest string"))


def test_round_trip(spark, archive):
    assert archive.payloads.count() == len({r[2] or "" for r in ROWS})
    stored = {bytes(r["digest"]): zstandard.ZstdDecompressor().decompress(bytes(r["payload"])) for r in archive.payloads.collect()}
    got = []
    for r in wa.records(archive).collect():
        fields, block = wa.parse(bytes(r["record"]))
        raw = stored[bytes(r["digest"])]
        assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert block == (raw if fields["WARC-Type"] == "response" else b"")
        got.append((fields["WARC-Record-ID"], fields["WARC-Type"], fields.get("WARC-Refers-To"), raw.decode()))
    by = {}
    for i, _, h in ROWS:
        by.setdefault(h or "", []).append(i)
    want = []
    for i, _, h in ROWS:
        ids = [x for x in by[h or ""] if x is not None]
        top = max(ids) if ids else None
        want.append((wa.record_id(i), "response" if i == top else "revisit", None if i == top else wa.record_id(top), h or ""))
    key = lambda x: tuple(map(str, x))
    assert sorted(got, key=key) == sorted(want, key=key)


def test_damage_is_noticed(spark, archive):
    archive.payloads = archive.payloads.withColumn("payload", F.when(F.length("payload") > 40, F.col("payload")).otherwise(archive.payloads.select("payload").first()[0]))
    with pytest.raises(Exception, match="digest"):
        wa.records(archive).collect()


def test_empty(spark):
    a = wa.write(spark, spark.createDataFrame([], "page_id long, url string, html string"))
    assert wa.records(a).count() == 0


def test_summaries(spark):
    big = (1 << 60) + 1
    rows = [(big, "u", "a"), (big + 2, "u", "a"), (None, "u", "b"), (-(1 << 63), "u", "b"), (None, "u", "c"), (3, None, None), (4, "u", "")]
    got = {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in wa.summaries(spark, wa.write(spark, spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    sha = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
    low = -(1 << 63)
    want = {(big, 1, sha(b"a"), "revisit", big + 2), (big + 2, 1, sha(b"a"), "response", None), (None, 1, sha(b"b"), "revisit", low), (low, 1, sha(b"b"), "response", None), (None, 1, sha(b"c"), "response", None), (3, 0, sha(b""), "revisit", 4), (4, 0, sha(b""), "response", None)}
    assert got == want


def test_payloads_travel_once(spark, archive):
    """Of the exchanges that read the archive back, one has payloads and none has records."""
    found = []

    def walk(node):
        if "Exchange" in node.nodeName():
            found.append({node.output().apply(k).name() for k in range(node.output().size())})
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # these tables are small
    try:
        walk(wa.summaries(spark, archive)._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("payload" in x for x in found) == 1 and not any("record" in x for x in found)


def test_wrong_records_are_noticed(spark, archive):
    told = archive.headers
    for kind in ("response", "revisit"):
        damaged = F.when(F.col("revisit") == F.lit(kind == "revisit"), F.regexp_replace(F.col("header").cast("string"), "sha1:.", "sha1:!").cast("binary")).otherwise(F.col("header"))
        archive.headers = told.withColumn("header", damaged)
        with pytest.raises(Exception, match="agree"):
            wa.summaries(spark, archive).collect()
