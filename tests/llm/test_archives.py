"""Archives of pages: written, read back, damaged, in pieces."""

import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

from resonance.llm import warc

LONG = "é\r\n\r\nWARC/1.1\r\n" * 60_000
ROWS = [
    (1, "u", "x" * 300), (2, "u\r\nX: y", "x" * 300), (2, "u", "x" * 300), (None, None, "x" * 300), (1, "u", "x" * 300),
    (3, None, None), (4, "é", "short"), (5, "u", "short"), (6, "u", LONG), (7, "u", LONG), (None, None, "y" * 100),
    (8, "u", "z" * 99), (9, "u", "z" * 99), (1152921504606846977, "u", "w" * 200), (1152921504606846978, "u", "w" * 200),
    (None, "u", None),
]
SCHEMA = "page_id long, url string, html string, digest string, key int, payload string, last boolean"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "d", 1, "p", True) for r in ROWS], SCHEMA).repartition(3)


def expected(rows):
    first = {}
    for key, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and key is not None:
            first[data] = min(key, first.get(data, key))
    out = []
    for key, _, html in rows:
        data = (html or "").encode()
        refers = first.get(data)
        refers = None if refers == key else refers
        out.append((key, len(data), hashlib.sha256(data).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def test_round_trip_of_odd_pages(pages):
    got = [tuple(r) for r in warc.round_trip(pages).collect()]
    assert sorted(got, key=repr) == expected(ROWS)


def test_no_pages(spark):
    found = warc.round_trip(spark.createDataFrame([], SCHEMA))
    assert found.collect() == [] and dict(found.dtypes)["page_id"] == "bigint"


def test_content_comes_back_in_chunks(pages, tmp_path):
    files = warc.write_archives(warc.records(pages), str(tmp_path / "a"))
    assert files.agg(F.sum("n_records")).first()[0] == len(ROWS)
    chunks = warc.read_archives(files, content=True).where("record_type = 'response'").collect()
    by_record = {}
    for c in sorted(chunks, key=lambda c: c["chunk_no"]):
        assert len(c["content"]) <= warc.CHUNK
        by_record.setdefault(c["record_id"], []).append(c)
    long = [v for v in by_record.values() if v[0]["record_key"] == "6"][0]
    assert len(long) == -(-len(LONG.encode()) // warc.CHUNK) > 3
    state = hashlib.sha256()
    for c in long:
        state.update(c["content"])
        assert (c["payload_digest"], c["last"]) == (state.hexdigest(), c is long[-1])
    assert state.hexdigest() == hashlib.sha256(LONG.encode()).hexdigest()


def test_equal_payloads_are_stored_once(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("ab"), 5000).alias("html"))
    files = warc.write_archives(warc.records(rows), str(tmp_path / "a"))
    kinds = warc.read_archives(files).groupBy("record_type").agg(F.count("*"), F.sum("payload_bytes")).collect()
    assert {(k, n, size) for k, n, size in kinds if k != "warcinfo"} == {("response", 1, 10_000), ("revisit", 399, 0)}


@pytest.mark.parametrize("size", [1, 3, 7, 100])
def test_chunks_of_a_row(spark, size):
    texts = [None, "", "a", "abc", "abcdefg", "é" * 20]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, payload string")
    rows = warc.in_chunks(rows.withColumn("payload", F.col("payload").cast("binary")), size=size).collect()
    for i, t in enumerate(texts):
        mine = [r for r in rows if r["i"] == i]
        data = (t or "").encode()
        assert [bytes(r["content"]) for r in mine] == [data[k: k + size] for k in range(0, max(len(data), 1), size)]
        assert [r["last"] for r in mine] == [False] * (len(mine) - 1) + [True]


def record(body: bytes, digest: str | None = None, more: bytes = b"") -> bytes:
    digest = digest or hashlib.sha256(body).hexdigest()
    return (b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nWARC-Payload-Digest: sha256:" + digest.encode()
            + b"\r\nX-Folded: a\r\n b\r\nContent-Length: %d\r\n\r\n" % (len(body) + len(more)) + more + body + b"\r\n\r\n")


def read(data: bytes) -> list:
    return list(warc.read_stream(io.BytesIO(data), "here", True))


@pytest.mark.parametrize("packed", [True, False])
def test_archives_of_others(packed, monkeypatch):
    monkeypatch.setattr(warc, "READ", 11)
    monkeypatch.setattr(warc, "CHUNK", 16)
    bodies = [b"", b"one", b"x" * 100, b"\r\n\r\n", b"WARC/1.0\r\n"]
    data = b"".join(gzip.compress(record(b)) if packed else record(b) for b in bodies)
    rows = read(data)
    whole = [r for r in rows if r[9]]
    assert [r[7] for r in whole] == [len(b) for b in bodies]
    assert b"".join(r[10] for r in rows) == b"".join(bodies)


def test_damage_is_an_error():
    with pytest.raises(ValueError, match="urn:x ends"):
        read(record(b"a" * 50)[:-30])
    with pytest.raises(ValueError, match="does not have its digest"):
        read(record(b"abc", "00"))
    with pytest.raises(ValueError, match="no record begins"):
        read(b"junk\r\n" + record(b"abc"))


def test_revisit_of_nothing_is_an_error(spark):
    row = ("a", "revisit", "1", None, "urn:none", "00", 0, 0, "00", True, None)
    with pytest.raises(Exception, match="revisit of another payload"):
        warc.resolved(spark.createDataFrame([row], warc.CHUNKS)).collect()
