"""Pages of an Ogg container around coded packets, made by running offsets, and packets read back from them.

A packet is laced into segments of 255 bytes, the last one shorter; a page holds 255 segments, so the page of a segment follows from how
many come before it in its entry, and packets are cut where pages end. Only the numbers of segments are summed along an entry; a page is
made by itself, of at most 255 packets and 65 kB, however long the entry is. The codec's own packets are given.

Edge cases (tests/test_container.py): null packets are empty ones, whose lacing is one zero; a page on which no packet ends has granule
-1; an entry without packets has its header pages alone, if it is named; packets that are equal in order come in any order; an empty table
gives no pages; what isn't a page, has a wrong checksum or a page missing is an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lectern.session import settle

SEGMENT, SEGMENTS = 255, 255
CONTINUED, FIRST, LAST = 1, 2, 4
#: Pages before those of sound: the head and the tags.
HEADERS = 2
_MIRRORED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(page: bytes) -> int:
    """CRC-32 with the polynomial 0x04C11DB7, highest bits first, from zero: zlib's, which takes lowest bits first, of mirrored bytes."""
    found = zlib.crc32(page.translate(_MIRRORED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{found:032b}"[::-1], 2)


def page_bytes(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = struct.pack("<4sBBqIII", b"OggS", 0, flags, granule, serial, number, 0) + bytes([len(lacing)]) + lacing
    return head[:22] + struct.pack("<I", checksum(head + body)) + head[26:] + body


def head_packet(rate: int, skip: int = 312, channels: int = 1) -> bytes:
    return struct.pack("<8sBBHIhB", b"OpusHead", 1, channels, skip, rate, 0, 0)


def tags_packet(vendor: str = "lectern") -> bytes:
    name = vendor.encode()
    return struct.pack(f"<8sI{len(name)}sI", b"OpusTags", len(name), name, 0)


def page_parts(packets: DataFrame, key: str, order: str, data: str, granule: str) -> DataFrame:
    """(key, page, parts, last): what each page of sound holds, array<struct<at, data, segments, rest, begins, ends, granule>>, in order.

    rest is the lacing value of a part's last segment; `last` says whether it is the entry's last page.
    """
    rows = settle(packets.select(F.col(key).alias("key"), F.col(order).alias("order"), F.coalesce(F.col(data), F.lit(b"")).alias("data"), F.col(granule).cast("long").alias("granule"), F.monotonically_increasing_id().alias("row")), "packets")
    count = (F.floor(F.octet_length("data") / SEGMENT) + 1).cast("long")
    before = Window.partitionBy("key").orderBy("order", "row").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.select("key", "order", "row", count.alias("segments"))
    offsets = counts.select("row", "segments", F.coalesce(F.sum("segments").over(before), F.lit(0)).alias("offset"))
    ends = counts.groupBy("key").agg(F.sum("segments").alias("total")).select(F.col("key").alias("entry of pages"), F.floor((F.col("total") - 1) / SEGMENTS).alias("last page"))
    cut = rows.join(offsets, "row").withColumn("page", F.explode(F.sequence(F.floor(F.col("offset") / SEGMENTS), F.floor((F.col("offset") + F.col("segments") - 1) / SEGMENTS))))
    low = F.greatest(F.col("page") * SEGMENTS - F.col("offset"), F.lit(0))
    high = F.least((F.col("page") + 1) * SEGMENTS - F.col("offset"), F.col("segments"))
    over = high == F.col("segments")
    part = F.struct(
        (F.col("offset") + low).alias("at"), F.substring(F.col("data"), (low * SEGMENT + 1).cast("int"), ((high - low) * SEGMENT).cast("int")).alias("data"), (high - low).cast("int").alias("segments"),
        F.when(over, F.octet_length("data") % SEGMENT).otherwise(F.lit(SEGMENT)).cast("int").alias("rest"), (low == 0).alias("begins"), over.alias("ends"), "granule",
    )
    pages = cut.select("key", "page", part.alias("part")).groupBy("key", "page").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    joined = pages.join(ends, F.col("key").eqNullSafe(F.col("entry of pages")))
    return joined.select(F.col("key").alias(key), "page", "parts", (F.col("page") == F.col("last page")).alias("last"))


def container_pages(packets: DataFrame, key: str, order: str, data: str, granule: str, rate: int, serial: int = 1, entries: DataFrame | None = None) -> DataFrame:
    """(key, page, granule, segments, flags, content) of the containers of all entries, head and tags first.

    packets are (key, order, data binary, granule after the packet); entries (key) names those that have a container though they have no
    packets.
    """
    sound = page_parts(packets, key, order, data, granule)
    named = packets.select(key) if entries is None else packets.select(key).unionByName(entries.select(key))
    with_sound = packets.select(F.col(key).alias("entry of pages"), F.lit(True).alias("with sound")).distinct()
    heads = named.distinct().join(with_sound, F.col(key).eqNullSafe(F.col("entry of pages")), "left").select(key, F.coalesce("with sound", F.lit(False)).alias("with sound"))
    kind = packets.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, page long, granule long, segments int, flags int, content binary"

    def laced(data: bytes) -> bytes:
        return bytes([SEGMENT]) * (len(data) // SEGMENT) + bytes([len(data) % SEGMENT])

    def out(keys, rows):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([keys, *(pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 5, kinds))], [key, "page", "granule", "segments", "flags", "content"])

    def head(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for sounds in batch.column(1).to_pylist():
                for number, packet in enumerate((head_packet(rate), tags_packet())):
                    flags = FIRST if not number else 0 if sounds else LAST
                    rows.append((number, 0, len(laced(packet)), flags, page_bytes(flags, 0, serial, number, laced(packet), packet)))
            yield out(batch.column(0).take(pa.array([i for i in range(batch.num_rows) for _ in range(HEADERS)], pa.int32())), rows)

    def body(batches: Iterator) -> Iterator:
        for batch in batches:
            rows = []
            for page, parts, last in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                lacing = b"".join(bytes([SEGMENT]) * (p["segments"] - 1) + bytes([p["rest"]]) for p in parts)
                ended = [p["granule"] for p in parts if p["ends"]]
                flags = (0 if parts[0]["begins"] else CONTINUED) | (LAST if last else 0)
                at = ended[-1] if ended else -1
                rows.append((page + HEADERS, at, len(lacing), flags, page_bytes(flags, at, serial, page + HEADERS, lacing, b"".join(p["data"] for p in parts))))
            yield out(batch.column(0), rows)

    return heads.mapInArrow(head, schema).unionByName(sound.mapInArrow(body, schema))


def packets_of(content: bytes) -> Iterator[tuple[bytes, int]]:
    """(packet, granule of the page on which it ends) of a container, its pages checked."""
    at, number, held = 0, 0, None
    while at < len(content):
        if content[at : at + 4] != b"OggS" or len(content) < at + 27:
            raise ValueError(f"no page at byte {at}")
        _, _, flags, granule, _, sequence, crc, count = struct.unpack("<4sBBqIIIB", content[at : at + 27])
        lacing = content[at + 27 : at + 27 + count]
        stop = at + 27 + count + sum(lacing)
        page = content[at:stop]
        if sequence != number or len(page) < stop - at or checksum(page[:22] + bytes(4) + page[26:]) != crc or bool(flags & CONTINUED) != (held is not None):
            raise ValueError(f"page {number} at byte {at} is not whole")
        body = at + 27 + count
        for size in lacing:
            held = (held or b"") + content[body : body + size]
            body += size
            if size < SEGMENT:
                yield held, granule
                held = None
        at, number = stop, number + 1
    if held is not None:
        raise ValueError("the last packet has no end")


def read_packets(containers: DataFrame, key: str, content: str) -> DataFrame:
    """(key, idx, data, granule) of the packets of sound in a table of containers (key, content); granule is that of the packet's page."""
    kind = containers.schema[key].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for i, value in enumerate(batch.column(1)):
                found = list(packets_of(value.as_py() or b""))[HEADERS:]
                keys = batch.column(0).take(pa.array([i] * len(found), pa.int32()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(range(len(found)), pa.int32()), pa.array([p for p, _ in found], pa.binary()), pa.array([g for _, g in found], pa.int64())], [key, "idx", "data", "granule"])

    return containers.select(key, F.col(content).cast("binary")).mapInArrow(run, f"`{key}` {kind}, idx int, data binary, granule long")


def joined_pages(pages: DataFrame, key: str) -> DataFrame:
    """(key, content): whole containers, for those that are short enough to be a row."""
    ordered = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page", "content"))).alias("pages"))
    return ordered.select(key, F.aggregate("pages", F.lit(b""), lambda acc, p: F.concat(acc, p["content"])).alias("content"))
