"""Pages against a plain writer, packets read back, and broken containers."""

import random
import struct

import duckdb
import pytest

from lectern.plans import catalogue
from lectern.sources import container as C


def crc_by_rule(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
    return crc


def brute(packets):
    """Pages of sound: segments dealt one by one."""
    segments = []
    for data, granule in packets:
        n = len(data) // 255 + 1
        segments += [(data[255 * k : 255 * k + 255], k == 0, granule if k == n - 1 else None) for k in range(n)]
    out = []
    for low in range(0, len(segments), 255):
        part = segments[low : low + 255]
        granule = ([-1] + [g for *_, g in part if g is not None])[-1]
        flags = (0 if part[0][1] else 1) | (4 if low + 255 >= len(segments) else 0)
        out.append((low // 255 + 2, granule, len(part), flags, bytes(len(x) for x, *_ in part), b"".join(x for x, *_ in part)))
    return out


def clips():
    r = random.Random(4)
    sizes = {"a": [r.choice([0, 1, 80, 254, 255, 256, 510, 700]) for _ in range(400)], "b": [70_000, 3, 65_025, 130_000], "c": [255 * 254], "d": [10], None: [5, 5]}
    return {k: [(r.randbytes(n), 960 * (i + 1)) for i, n in enumerate(v)] for k, v in sizes.items()}


def table(spark, found):
    rows = [(k, i, data, granule) for k, v in found.items() for i, (data, granule) in enumerate(v)]
    return spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "entry string, idx int, data binary, granule long").selectExpr("*", "1 AS key", "2 AS page")


def test_checksums():
    for data in (b"", b"a", b"OggS" + bytes(50), bytes(range(256)) * 3):
        assert C.checksum(data) == crc_by_rule(data)


def test_pages_and_packets(spark):
    found = clips()
    pages = C.container_pages(table(spark, found), "entry", "idx", "data", "granule", 48000, entries=spark.createDataFrame([("silent",), ("a",)], "entry string"))
    rows = {}
    for x in pages.collect():
        rows.setdefault(x.entry, {})[x.page] = x
    assert set(rows) == {*found, "silent"}
    for k, packets in found.items():
        for number, granule, n, flags, lacing, body in brute(packets):
            x = rows[k][number]
            assert (x.granule, x.segments, x.flags, bytes(x.content)) == (granule, n, flags, C.page_bytes(flags, granule, 1, number, lacing, body))
        assert len(rows[k]) == len(brute(packets)) + 2 and rows[k][0].flags == 2 and rows[k][1].flags == 0
    assert rows["silent"][1].flags == 4 and len(rows["silent"]) == 2
    assert bytes(rows["a"][0].content)[28:] == b"OpusHead" + struct.pack("<BBHIhB", 1, 1, 312, 48000, 0, 0)
    back = {}
    for x in C.read_packets(C.joined_pages(pages, "entry"), "entry", "content").orderBy("idx").collect():
        back.setdefault(x.entry, []).append(bytes(x.data))
    assert back == {k: [data for data, _ in v] for k, v in found.items()}
    assert C.container_pages(table(spark, found).limit(0), "entry", "idx", "data", "granule", 48000).count() == 0


def test_broken_containers():
    page = C.page_bytes(0, 5, 1, 0, bytes([3]), b"abc")
    assert list(C.packets_of(page)) == [(b"abc", 5)] and list(C.packets_of(b"")) == []
    for bad in (page[:-1], page[:-1] + b"x", b"x" + page, page + page, C.page_bytes(1, 5, 1, 0, bytes([3]), b"abc"), C.page_bytes(0, -1, 1, 0, bytes([255]), bytes(255))):
        with pytest.raises(ValueError, match="page|packet"):
            list(C.packets_of(bad))


def test_the_query_agrees_with_its_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.execute(catalogue.ORACLE_SQL["container_pages"])
    columns = [d[0] for d in want.description]
    got = catalogue.QUERIES["container_pages"](spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())
