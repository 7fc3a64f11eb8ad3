"""WARC archives: writing, reading back, and merging capture runs into ordered histories.

Every archive file is a capture run, sorted by URL key and timestamp, of records of ARCHIVE_BYTES together and one more at most; each
record is a gzip member of its own, so that an offset of the index finds it, and members follow one another without a byte between. Records hold an HTTP response whose payload is the page; of equal payloads of at least REVISIT_BYTES
bytes the page with the smallest id is the response and the others are revisits of it, whose records have the HTTP header alone.
Reading gives an index entry for each record. The merge is external: the entries are dealt to key ranges of about RANGE_ROWS, in each of
which every run's slice is brought back into the order in which its archive has it, and a loser tree merges the slices, entry by entry,
by URL key and time. No sort by key takes place; the ranges in turn hold the whole history in order.

Edge cases (tests/llm/test_warc.py): a null page is an empty payload; line breaks in URLs are percent-encoded and a null URL has no
target line and an empty key; pages with a null id revisit the smallest id of their payload, or are responses if it has none; rows
that repeat the smallest id are all responses, with record ids of their own; payloads may hold any bytes, record heads included; an
empty table gives no entries; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import forget, fresh_path, settle

REVISIT_BYTES = 100
#: Bytes of records that fill an archive: a task reads one at a time.
ARCHIVE_BYTES = 32 << 20
#: Index entries that one merging task holds, about.
RANGE_ROWS = 200_000
CAPTURED = "2024-01-01T00:00:00Z"
END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels from the right, then the rest, lower-cased; empty for null."""
    rest = F.regexp_replace(F.lower(url), r"^[a-z][a-z0-9+.-]*://", "")
    host, tail = F.regexp_extract(rest, r"(?s)^([^/?#]*)(.*)$", 1), F.regexp_extract(rest, r"(?s)^([^/?#]*)(.*)$", 2)
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), tail), F.lit(""))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", captured: Column | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """(url_key, captured, order, value): one WARC record per page, without the blank lines that end it; and the stored tables it reads.

    A record's id is the page's and the number of its row, as ids may be null or repeat; a revisit names its response's record.
    """
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("order"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"), (F.lit(CAPTURED) if captured is None else captured).alias("captured"))
    rows = settle(rows.withColumns({"bytes": F.octet_length("payload"), "digest": F.sha2("payload", 256)}), "pages")  # a row keeps its number
    first = rows.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min(F.when(F.col("order").isNotNull(), F.struct("order", "row"))).alias("first"), F.count("*").alias("n")).where("n > 1")
    kept, first = rows, settle(first.drop("n"), "first")
    rows = rows.join(first, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("order").eqNullSafe(F.col("first.order"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), "bytes", F.lit(END * 2))
    target = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))
    head = F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        F.lit("WARC-Record-ID: <urn:page:"), F.coalesce("id", F.lit("")), F.lit(";"), "row", F.lit(f">{END}"),
        line("WARC-Date", F.col("captured")),
        line("WARC-Target-URI", target),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}{END}WARC-Refers-To: <urn:page:"), F.col("first.order").cast("string"), F.lit(";"), F.col("first.row"), F.lit(f">{END}"))).otherwise(""),
        F.lit(f"Content-Type: application/http; msgtype=response{END}Content-Length: "),
        F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes")),
        F.lit(END * 2),
    )
    recs = rows.select(url_key(F.col("url")).alias("url_key"), "captured", "order", F.concat(head, http, F.when(revisit, "").otherwise(F.col("payload"))).alias("value"))
    return recs, [kept, first]


def _archives(most: int) -> Callable:
    """Rows of one archive each: the gzip members of its records, back to back, until the records have `most` bytes."""

    def run(batches: Iterator) -> Iterator:
        import gzip

        import pyarrow as pa

        held, size = [], 0

        def archive():
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held).removesuffix(b"\0")], pa.binary())], ["value"])

        for batch in batches:
            for x in batch.column(0).cast(pa.binary()):
                record = x.as_py() + b"\r\n\r\n"
                held.append(gzip.compress(record, 6, mtime=0))
                size += len(record)
                if size >= most:
                    yield archive()
                    held, size = [], 0
        if held:
            yield archive()

    return run


def write_archives(recs: DataFrame, path: str) -> None:
    """Archives of ARCHIVE_BYTES of records, each sorted by URL key and time, several for each partition.

    The text writer ends a file with a zero byte. That is the last byte of a gzip member, the highest of its size, for records under
    16 MB, and _archives() leaves it out; behind a larger record it is padding, which gzip allows at the end of a file.
    """
    ordered = recs.sortWithinPartitions("url_key", "captured", "order").select("value").mapInArrow(_archives(ARCHIVE_BYTES), "value binary")
    archives = ordered.select(F.col("value").cast("string").alias("value"))  # the same bytes, as the text writer asks for
    archives.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def members(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, unpacked bytes) of each gzip member."""
    import zlib

    at = 0
    while at < len(content):
        if not content[at] and not content[at:].strip(b"\0"):  # padding at the end
            return
        start, parts, unpack = at, [], zlib.decompressobj(31)
        while not unpack.eof:
            chunk = content[at : at + (1 << 14)]
            if not chunk:
                raise ValueError(f"member at byte {start} is cut short")
            parts.append(unpack.decompress(chunk))
            at += len(chunk) - len(unpack.unused_data)
        yield start, b"".join(parts)


def parse_archive(stream) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of each record of an open binary stream."""
    at = 0
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"no record at byte {at}: {line[:40]!r}")
        start, fields = at, {}
        at += len(line)
        while (line := stream.readline()) != b"\r\n":
            at += len(line)
            name, _, value = line[:-2].decode("utf-8", "replace").partition(": ")
            fields[name] = value
        size = int(fields["Content-Length"])
        block = stream.read(size)
        at += 2 + size + len(end := stream.read(4))
        if len(block) != size or end != b"\r\n\r\n":
            raise ValueError(f"record at byte {start} is cut short")
        yield start, fields, block


INDEX = "run string, offset long, record_id string, url string, captured string, record_type string, payload_digest string, payload_bytes long, refers_to string"


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """An index entry for each record of each archive; payloads of responses are digested again and must agree with their header."""
    names = [x.split()[0] for x in INDEX.split(", ")] + ["payload"] * with_payload

    def run(batches: Iterator) -> Iterator:
        import hashlib
        import io
        import re

        import pyarrow as pa

        def entries(file: str, content: bytes) -> Iterator[tuple]:
            for offset, fields, block in ((at, *record[1:]) for at, data in members(content) for record in parse_archive(io.BytesIO(data))):
                head, _, payload = block.partition(b"\r\n\r\n")
                digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"]
                size = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
                if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError(f"{file}, record at byte {offset}: payload and header differ")
                ids = [re.fullmatch("<urn:page:(.*);[0-9]+>", fields.get(x, "<urn:page:;0>"))[1] or None for x in ("WARC-Record-ID", "WARC-Refers-To")]
                row = file, offset, ids[0], fields.get("WARC-Target-URI"), fields.get("WARC-Date"), kind, digest, size, ids[1]
                yield (*row, payload if kind == "response" else None) if with_payload else row

        types = [pa.string(), pa.int64()] + [pa.string()] * 5 + [pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows: list = []
                for row in entries(file, content.as_py()):
                    rows.append(row)
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    found = files.mapInArrow(run, INDEX + ", payload binary" * with_payload)
    return found.withColumn("url_key", url_key(F.col("url")))


class LoserTree:
    """Merges sorted runs: an inner node keeps the loser of its match, so the next winner takes one match a level."""

    def __init__(self, runs: list[Iterator], key: Callable):
        self.runs, self.key, self.k = runs, key, len(runs)
        self.heads: list = [None] * self.k
        self.keys: list = [None] * self.k
        for i in range(self.k):
            self._next(i)
        self.losers = [-1] * self.k
        self.winner = self._build(1) if self.k > 1 else 0

    def _next(self, i: int) -> None:
        row = next(self.runs[i], None)
        self.heads[i], self.keys[i] = row, None if row is None else (self.key(row), i)

    def _beats(self, a: int, b: int) -> bool:
        return self.keys[b] is None or self.keys[a] is not None and self.keys[a] < self.keys[b]

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        win, self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        return win

    def __iter__(self) -> Iterator:
        while self.k and self.heads[self.winner] is not None:
            i = self.winner
            yield self.heads[i]
            self._next(i)
            node = (i + self.k) // 2
            while node:
                if self._beats(self.losers[node], i):
                    self.losers[node], i = i, self.losers[node]
                node //= 2
            self.winner = i


def merge_runs(index: DataFrame) -> DataFrame:
    """The entries of a stored index in order of URL key, time and place, range by range."""
    ranges = max(1, -(-index.count() // RANGE_ROWS))
    names = index.columns
    key_at = [names.index(x) for x in ("url_key", "captured", "run", "offset")]
    sliced = index.repartitionByRange(ranges, "url_key", "captured", "run", "offset").sortWithinPartitions("run", "offset")

    def run(batches: Iterator) -> Iterator:
        from itertools import islice

        import pyarrow as pa

        held = list(batches)  # of one range
        if not held:
            return
        table = pa.Table.from_batches(held)
        runs = table.column("run").combine_chunks().dictionary_encode().indices.to_numpy()
        edges = [0, *(runs[1:] != runs[:-1]).nonzero()[0] + 1, len(runs)]
        columns = [table.column(k).to_pylist() for k in key_at]
        keys = lambda i: tuple("" if (x := c[i]) is None else x for c in columns)
        merged = iter(LoserTree([iter(range(a, z)) for a, z in zip(edges, edges[1:])], keys))
        while order := list(islice(merged, 10_000)):
            yield from table.take(order).combine_chunks().to_batches()

    return sliced.mapInArrow(run, index.schema)


def capture_history(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", captured: Column | None = None) -> DataFrame:
    """Write pages as archives, at path or in the shared folder, read them back and merge their index."""
    path = path or fresh_path(pages.sparkSession, "archives")
    recs, kept = records(pages, id_col, url_col, html_col, captured)
    write_archives(recs, path)
    forget(*kept)
    return merge_runs(settle(read_archives(pages.sparkSession, path), "index"))
