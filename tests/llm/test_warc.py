"""Archives: round trips, records that are read alone, odd pages."""

import hashlib
import io
import random
import struct
import uuid

import duckdb
import pytest
import zstandard
from pyspark.sql import functions as F

from lightsieve.llm import queries, warc
from lightsieve.session import shared_path
from tests.test_queries import canonical

PAGES = "page_id long, url string, html string, digest string, payload string, id long"


def expected(rows):
    first = {}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    for k in order:
        first.setdefault(rows[k][2] or "", k)
    out = []
    for k, (page, _, html, *_) in enumerate(rows):
        body = (html or "").encode()
        again = len(body) >= 100 and first[html or ""] != k
        out.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", rows[first[html or ""]][0] if again else None))
    return sorted(out, key=repr)


def odd_pages():
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randrange(3, 9)))
    page = "<html>" + " ".join(word() for _ in range(60)) + "</html>"
    bodies = [None, "", None, "a" * 99, "a" * 99, "b" * 100, "b" * 100, "é" * 50, "é" * 50, page, page, page, "\r\n\r\nWARC/1.1\r\n\r\n" * 9, " ".join(word() for _ in range(400_000))]
    rows = [(i, [None, "http://a.b/c d\r\ne", "http://é/%20", ""][i % 4], b, "x", "y", 1) for i, b in enumerate(bodies)]
    rows += [(None, "u", page, None, None, None), (None, "u", "c" * 200, None, None, None), (None, "u", "c" * 200, None, None, None)]
    return rows + [(5, "u", "b" * 100, "x", "y", 1)] * 2 + [(50, "u", "d" * 300, "x", "y", 1)] * 3 + [(100 + i, "u", page + str(i), "x", "y", 1) for i in range(400)]


def test_odd_pages(spark):
    rows = odd_pages()
    pages = spark.createDataFrame(rows, PAGES).repartition(4)
    for most in (1 << 24, 20_000):
        found = [tuple(r) for r in warc.archive_pages(pages, archive_bytes=most).collect()]
        plain = expected(rows)
        assert sorted(found, key=repr) == plain
    assert warc.archive_pages(pages.limit(0)).count() == 0
    strings = pages.select(F.concat(F.lit("p\n% "), "page_id").alias("page_id"), "url", "html")
    assert {r["page_id"] for r in warc.archive_pages(strings).collect()} == {None if i is None else f"p\n% {i}" for i, *_ in rows}


def test_archives_stand_alone(spark):
    """A dictionary leads each archive that has enough to learn from; any record is read by its place alone."""
    rows = odd_pages()
    folder = shared_path(spark, "test-archives")
    index = warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(2), folder)
    entries = index.collect()
    assert len(entries) == len(rows) and len({e["record_id"] for e in entries}) == len(rows)
    payloads, urls = [], set()
    for name in {e["archive"] for e in entries}:
        raw = open(f"{folder.removeprefix('file:')}/{name}", "rb").read()
        magic, size = struct.unpack("<II", raw[:8])
        assert magic == 0x184D2A5D
        dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw[8 : 8 + size]))
        scanned = list(warc.scan(io.BytesIO(raw)))
        assert scanned[0].kind == "warcinfo" and scanned[0].offset == 8 + size and scanned[-1].offset + scanned[-1].length == len(raw)
        for e in (e for e in entries if e["archive"] == name):
            alone = warc.parse(zstandard.ZstdDecompressor(dict_data=dictionary).decompress(raw[e["offset"] : e["offset"] + e["length"]]))
            assert alone.kind == e["record_type"] and str(uuid.UUID(e["record_id"])) and e["record_id"] in alone.headers["WARC-Record-ID"]
            urls.add(warc._value(alone.headers.get("WARC-Target-URI")))
            if alone.kind == "response":
                payloads.append(alone.block.partition(b"\r\n\r\n")[2])
    assert set(payloads) == {(h or "").encode() for _, _, h, *_ in rows}
    assert urls == {u for _, u, *_ in rows}


def test_small_archives_and_broken_ones():
    few = [warc.record("warcinfo", [], b"x")]
    raw = b"".join(warc.archive(few))
    assert not raw.startswith(struct.pack("<I", warc.DICTIONARY_FRAME)) and [f.block for f in warc.scan(io.BytesIO(raw))] == [b"x"]
    with pytest.raises(ValueError):
        list(warc.scan(io.BytesIO(raw[:-3])))
    assert list(warc.scan(io.BytesIO(b""))) == []


def test_query_equals_sql(spark, sf_small):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf_small}/pages.parquet')")
    assert canonical(queries.op13_warc(spark, sf_small).toPandas()) == canonical(c.sql(queries.ORACLE_SQL["op13_warc"]).df())
