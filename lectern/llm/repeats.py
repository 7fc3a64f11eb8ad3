"""Removal of every byte that lies in a string of LENGTH bytes which also starts anywhere else.

Why not a suffix array: sorting all suffixes externally writes tuples of some 30 bytes for each byte of text, several times over, and
the answer needs common prefixes of LENGTH bytes only (README has a measured attempt). Instead, windows of LENGTH bytes are compared in
runs. What is equal is decided by XXH3 of the bytes themselves, 128 bits; the polynomial hashes, quickly had for all positions, only
choose where windows are anchored and what is compared, and equal bytes have equal ones:

1. Each window is named by its anchor, the position of its least GRAM-byte hash. Windows with one anchor are consecutive, a segment,
   and equal windows have equal anchors at equal offsets. Segments whose anchor occurs once hold no repeat and are left out, the more
   so as this is nearly all of them. A segment whose whole text (all its windows together) occurs twice is repeated as a whole.
2. Of the other segments, with one of each repeated one to compare with, windows are cut into cells of CELL offsets from the anchor.
   The part that all windows of a cell share must occur twice for any of them to; a cell whose whole text occurs twice is repeated.
3. What is left, the cells in which a repeat begins or ends, is compared window by window.

Every step counts hashes with partial aggregation, so a passage that a third of all documents share is a few hot keys that are summed
where they are read. Equal texts are one text to compare; a text that occurs twice is repeated as a whole.

Edge cases (tests/llm/test_repeats.py): texts under LENGTH bytes hold no repeat, null ones count as empty; matches never cross
texts, but may overlap within one; repeated rows repeat each other; a null id is kept; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.session import settle

LENGTH, GRAM, CELL = 200, 32, 22
#: Window starts that are worked on at a time.
BLOCK = 1 << 20
BASE = 0x9E3779B97F4A7C15
_POWERS: dict = {}


def _powers(n: int):
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    import numpy as np

    if _POWERS.get("n", 0) < n:
        n = 1 << max(14, (n - 1).bit_length())
        for x in (BASE, pow(BASE, -1, 2**64)):
            row = np.full(n, x, np.uint64)
            row[0] = 1
            _POWERS[x] = np.multiply.accumulate(row)
        _POWERS["n"] = n
    return _POWERS[BASE], _POWERS[pow(BASE, -1, 2**64)]


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def names(data: bytes, start, stop):
    """Two arrays of 64 bits, XXH3-128 of the bytes from start to stop, arrays of equal size."""
    import numpy as np
    import xxhash

    digest = xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([digest(data[a:z]) for a, z in zip(start.tolist(), stop.tolist())]), ">u8").reshape(-1, 2)
    return both[:, 0].astype(np.uint64), both[:, 1].astype(np.uint64)


class Hashes:
    """Hashes of any parts of a string, polynomials modulo 2**64 from running sums: equal parts have equal ones, others may."""

    def __init__(self, data: bytes):
        import numpy as np

        values = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
        self.power, inverse = _powers(len(values) + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * inverse[: len(values)])))

    def of(self, start, stop, salt=0):
        """Of the parts from start to stop, arrays of equal size; salt tells apart what must not be compared."""
        import numpy as np

        return _mixed(_mixed((self.sums[stop] - self.sums[start]) * self.power[start]) + (np.asarray(stop - start).astype(np.uint64) << np.uint64(8)) + np.asarray(salt).astype(np.uint64))


def segments(data: bytes, length: int = LENGTH, gram: int = GRAM):
    """(first, last, anchor, hash of the anchor, u1, u2) of each segment: window starts, inclusive, and the hashes of its text."""
    import numpy as np

    out = []
    for low in range(0, len(data) - length + 1, BLOCK):
        part = data[low : low + BLOCK + length - 1]
        h = Hashes(part)
        grams = np.arange(len(part) - gram + 1)
        g = h.of(grams, grams + gram)
        wide, n = length - gram + 1, len(part) - length + 1
        keyed = (g >> np.uint64(21) << np.uint64(21)) | grams.astype(np.uint64)  # on a tie the leftmost
        padded = np.full(-(-len(keyed) // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(keyed)] = keyed
        rows = padded.reshape(-1, wide)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        anchors = (np.minimum(behind[:n], ahead[wide - 1 : wide - 1 + n]) & np.uint64((1 << 21) - 1)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(anchors[1:] != anchors[:-1]) + 1))
        last = np.append(first[1:], n) - 1
        at = anchors[first]
        out.append((first + low, last + low, at + low, g[at], *names(part, first, last + length)))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 6


def cells(data: bytes, found, length: int = LENGTH):
    """(segment number, first, last, core hash, v1, v2) of each cell of segments (first, last, anchor)."""
    import numpy as np

    first, last, anchor = (np.asarray(x, np.int64) for x in found)
    h = Hashes(data)
    near, far = (anchor - last) // CELL, (anchor - first) // CELL
    count = far - near + 1
    k = np.repeat(np.arange(len(first)), count)
    j = near[k] + np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count)
    a = anchor[k]
    low, high = np.maximum(first[k], a - CELL * j - CELL + 1), np.minimum(last[k], a - CELL * j)
    core_start, core_stop = a - CELL * j, a - np.minimum(CELL * j + CELL - 1, length - GRAM) + length
    return k, low, high, h.of(core_start, core_stop, 2 + j), *names(data, low, high + length)


def windows(data: bytes, found, length: int = LENGTH):
    """(cell number, start, w1, w2) of each window of cells (first, last)."""
    import numpy as np

    first, last = (np.asarray(x, np.int64) for x in found)
    count = last - first + 1
    k = np.repeat(np.arange(len(first)), count)
    s = first[k] + np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count)
    return k, s, *names(data, s, s + length)


def removed_spans(first, last, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal spans of bytes that windows from first to last cover."""
    spans: list[tuple[int, int]] = []
    for a, z in sorted(zip(first, last)):
        if spans and a <= spans[-1][1]:
            spans[-1] = spans[-1][0], max(spans[-1][1], z + length)
        else:
            spans.append((a, z + length))
    return spans


_TEXT = ["r1", "r2"]


def _texts(docs: DataFrame, text_col: str, *more) -> DataFrame:
    """(r1, r2, text, more...): texts are told apart by 128 bits made of their SHA-256."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(text, 256)
    return docs.select(F.xxhash64(digest).alias("r1"), F.xxhash64(F.lit("second"), digest).alias("r2"), text.alias("text"), *more)


def _signed(x):
    import pyarrow as pa

    return pa.array(x.view("int64") if x.dtype == "uint64" else x, pa.int64())


def _each(df: DataFrame, schema: str, columns: int, work) -> DataFrame:
    """work(bytes, lists) -> (row in those lists, arrays...) for each row (r1, r2, text, lists...), as rows of r1, r2 and the arrays."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for low in range(0, batch.num_rows, 100):
                rows, parts = [], []
                for i in range(low, min(low + 100, batch.num_rows)):
                    found = work(texts[i].as_py(), [batch.column(3 + c)[i].values.to_numpy() for c in range(columns)])
                    parts.append(found)
                    rows.append(np.full(len(found[0]), i, np.int32))
                rows = pa.array(np.concatenate(rows), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), *(_signed(np.concatenate(x)) for x in zip(*parts))], names)

    return df.mapInArrow(run, schema)


def _often(rows: DataFrame, *key: str) -> DataFrame:
    """rows whose key occurs twice or more; the join, on complements, can split hot keys, as it doesn't reuse the aggregate's distribution."""
    many = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*[F.bitwise_not(k).alias(f"often {k}") for k in key])
    return rows.join(many, [F.bitwise_not(k) == F.col(f"often {k}") for k in key], "left_semi")


def _counted(rows: DataFrame, key: tuple[str, str], part: str) -> tuple[DataFrame, DataFrame]:
    """rows with `n`, how often their key of 128 bits occurs, and one row for each key, for those parts that hold two keys or more."""
    one = F.min(F.struct(*[c for c in rows.columns if c not in key])).alias("one")
    keys = settle(rows.groupBy(*key).agg(F.count("*").alias("n"), one), "keys")
    return rows.join(keys.select(*key, "n"), list(key)), _often(keys.select(*key, "one.*", "n"), part)


def repeated_windows(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(r1, r2, first, last) of runs of repeated windows of each distinct text, in a stored table; not of texts as wholes."""
    texts = _texts(docs, text_col)
    long = texts.where(F.octet_length("text") >= length)
    columns = "r1 long, r2 long, first long, last long, anchor long, g long, u1 long, u2 long"
    all_segments = settle(_each(long, columns, 0, lambda data, _: segments(data, length)), "segments")
    some = settle(_often(all_segments, "g").distinct(), "candidates")
    counted, ones = _counted(some, ("u1", "u2"), "g")
    whole = counted.where("n > 1").select(*_TEXT, "first", "last")

    lists = lambda rows, *names: rows.groupBy(*_TEXT).agg(F.collect_list(F.struct(*names)).alias("found")).select(*_TEXT, *[F.col(f"found.{x}").alias(f"l_{x}") for x in names])
    asked = settle(lists(ones, "first", "last", "anchor", "n"), "asked")
    columns = "r1 long, r2 long, first long, last long, done long, core long, v1 long, v2 long"

    def cut(data: bytes, found):
        k, low, high, core, v1, v2 = cells(data, found[:3], length)
        return low, high, found[3][k], core, v1, v2

    cut_up = _often(_each(texts.join(asked, _TEXT), columns, 4, cut).distinct(), "core")
    counted, ones = _counted(settle(cut_up, "cells"), ("v1", "v2"), "core")
    parts = counted.where("n > 1 AND done = 1").select(*_TEXT, "first", "last")

    asked = settle(lists(ones.withColumn("done", F.greatest("done", "n")), "first", "last", "done"), "asked")
    columns = "r1 long, r2 long, first long, done long, w1 long, w2 long"

    def single(data: bytes, found):
        k, start, w1, w2 = windows(data, found[:2], length)
        return start, found[2][k], w1, w2

    edges = _often(settle(_each(texts.join(asked, _TEXT), columns, 3, single).distinct(), "windows"), "w1", "w2")
    edges = edges.where("done = 1").select(*_TEXT, "first", F.col("first").alias("last"))
    return settle(whole.unionByName(parts).unionByName(edges), "repeated")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id, n_bytes, removed array<struct<start, end>>, kept binary) for every row of docs: byte spans, and the bytes outside them."""
    runs = repeated_windows(docs, text_col, length)
    runs = runs.groupBy(*_TEXT).agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last"))
    texts = _texts(docs, text_col)
    copies = texts.groupBy(*_TEXT).agg(F.count("*").alias("n")).where("n > 1")
    known = settle(copies.join(runs, _TEXT, "full_outer"), "known")
    full = _texts(docs, text_col, F.col(id_col).alias("id"))
    full = full.join(known, _TEXT, "left").select("id", "text", F.coalesce("n", F.lit(1)).alias("n"), "first", "last")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                sizes, spans, kept = [], [], []
                for data, n, first, last in zip(part.column(1).cast(pa.binary()).to_pylist(), *(part.column(i).to_pylist() for i in (2, 3, 4))):
                    found = [(0, len(data))] if n > 1 and len(data) >= length else removed_spans(first or [], last or [], length)
                    sizes.append(len(data))
                    spans.append([{"start": a, "end": z} for a, z in found])
                    kept.append(b"".join(data[z:a] for z, a in zip([0, *(z for _, z in found)], [*(a for a, _ in found), len(data)])))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["id", "n_bytes", "removed", "kept"])

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("removed", span), T.StructField("kept", T.BinaryType())])
    return full.mapInArrow(run, schema)
