import gzip
import hashlib
import io
import random
import subprocess
import zlib

from pyspark.sql import functions as F

from lectern.llm import warc

NASTY = "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def brute(rows):
    first = {}
    for k, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100:
            first.setdefault(data, []).append(k)
    out = []
    for k, _, html in rows:
        data = (html or "").encode()
        same = first.get(data, [])
        least = min((x for x in same if x is not None), default=None)
        revisit = len(same) > 1 and least is not None and k != least
        out.append((k, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", least if revisit else None))
    return sorted(out, key=repr)


def test_round_trip_and_order(spark, tmp_path):
    r = random.Random(8)
    rows = [(i, r.choice(["http://b.example.com/x", "https://a.example.org/?q=1", "x", f"http://h{i}.net/{i}"]), r.choice(["é" * 60, "y" * 100, "z" * 99, NASTY * 3, f"page {i}", "q" * 3000 + str(i)])) for i in range(300)]
    rows += [(1000, None, None), (1001, "http://a/\r\nX: y", ""), (1002, "", "é" * 50), (5, "u", "y" * 100), (None, "u", "y" * 100), (None, "n", "only null" * 30), (None, "n", "only null" * 30), (1003, "big", "w" * 3_000_000)]
    pages = spark.createDataFrame([(*x, 1, 2) for x in rows], "page_id long, url string, html string, digest int, first int").repartition(5)
    path = f"{tmp_path}/archives"
    got = warc.capture_history(pages, path).collect()
    assert sorted(((r.record_id and int(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in got), key=repr) == brute(rows)
    keys = [(r.url_key, r.captured) for r in got]
    assert keys == sorted(keys)
    for r in got[::7]:
        with open(r.run.removeprefix("file:"), "rb") as f:
            f.seek(r.offset)
            _, fields, _ = next(warc.parse_archive(gzip.GzipFile(fileobj=f)))
        assert fields.get("WARC-Target-URI") == r.url and fields["WARC-Payload-Digest"].endswith(r.payload_digest)
    heads = [line for f in (tmp_path / "archives").glob("part-*") for _, fields, _ in warc.parse_archive(gzip.open(f)) for line in [fields]]
    ids = [x["WARC-Record-ID"] for x in heads]
    assert len(set(ids)) == len(ids) == len(rows) and {x["WARC-Refers-To"] for x in heads if "WARC-Refers-To" in x} <= set(ids)
    read = warc.read_archives(spark, path, with_payload=True).where("record_type = 'response'").collect()
    assert {(r.record_id, bytes(r.payload).decode()) for r in read} <= {(str(k) if k is not None else None, h or "") for k, _, h in rows}


def test_ranges_hold_the_order(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 50)
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("http://hot.com/"), F.when(F.col("id") % 3 == 0, "").otherwise(F.col("id").cast("string"))).alias("url"), F.lit("text").alias("html"))
    got = warc.capture_history(pages.repartition(4), captured=F.lit("2020-01-01T00:00:00Z")).collect()
    keys = [(r.url_key, r.captured, r.run, r.offset) for r in got]
    assert len(keys) == 400 and keys == sorted(keys)


def test_archives_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 5000)
    pages = spark.range(100).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.com/"), F.col("id") * 7 % 100).alias("url"), F.repeat(F.lit("x"), 500).alias("html"))
    got = warc.capture_history(pages.repartition(2), f"{tmp_path}/archives").collect()
    sizes = [len(gzip.decompress(f.read_bytes())) for f in (tmp_path / "archives").glob("part-*")]
    assert max(sizes) < 5000 + 1100 and sum(size < 5000 for size in sizes) <= 2  # one record more at most, and the last archive of a partition
    keys = [r.url_key for r in got]
    assert len(got) == 100 and keys == sorted(keys)


def test_loser_tree():
    r = random.Random(9)
    for k in range(0, 12):
        runs = [sorted(r.choices(range(20), k=r.randint(0, 8))) for _ in range(k)]
        assert list(warc.LoserTree([iter(x) for x in runs], lambda x: x)) == sorted(sum(runs, []))


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.capture_history(pages).count() == 0


def test_plain_gzip_reads_every_record(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.org/{i}", f"page {i} " * (i % 50)) for i in range(300)] + [(1000, "http://big.org/", "w" * (17 << 20)), (1001, "http://z.org/", "last")], "page_id long, url string, html string")
    path = f"{tmp_path}/archives"
    assert warc.capture_history(pages.coalesce(2), path).count() == 302
    heads, sizes = 0, []
    for file in (tmp_path / "archives").glob("part-*"):
        found = subprocess.run(["zcat", file], capture_output=True)
        assert found.returncode == 0 and not found.stderr
        heads += sum(1 for _ in warc.parse_archive(io.BytesIO(found.stdout)))
        content, sizes = file.read_bytes(), [*sizes, len(found.stdout)]
        while content.strip(b"\0"):  # a member, then the next one at once
            unpack = zlib.decompressobj(31)
            unpack.decompress(content)
            assert unpack.eof
            content = unpack.unused_data
    assert heads == 302 and len(sizes) > 20 and sorted(sizes)[-2] < 4000 + 2000
