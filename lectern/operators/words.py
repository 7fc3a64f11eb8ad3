"""Words, lines and chunks of texts with their codepoint spans, and the times at which words are spoken.

Spans and shares of letters are worked out in the row, in Arrow batches; nothing is shuffled by document,
but tables too small to fill all tasks are spread over them.

Edge cases (tests/test_words.py): null and empty texts have no words, an empty text has one empty line, a null one none; repeated rows
and null ids give their words each; an empty table gives no rows; other columns are carried only if named.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from lectern.session import spread

_WORD, _SPACED = r"\w+", "[^ ]+"  # runs of signs of one kind


def spans(docs: DataFrame, keep: list[str], text_col: str, cut: Callable[[str], list[tuple[int, int, int]]], text_name: str = "word") -> DataFrame:
    """(keep..., idx, word, start, end_pos, before, total) of the pieces (idx, start, stop) that cut finds in each text.

    before and total are the letters of the pieces before it, and of all pieces of its text.
    """
    names = [*keep, "idx", text_name, "start", "end_pos", "before", "total"]
    kinds = [T.IntegerType(), T.StringType(), *[T.LongType()] * 4]
    schema = T.StructType([*(docs.schema[c] for c in keep), *[T.StructField(n, k) for n, k in zip(names[len(keep) :], kinds)]])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                rows, found, pieces, total = [], [], [], []
                for i, text in enumerate(part.column(len(keep)).to_pylist()):
                    spans = cut(text) if text is not None else []
                    rows.append(len(spans))
                    found += spans
                    pieces += [text[a:z] for _, a, z in spans]
                    total.append(sum(z - a for _, a, z in spans))
                table = np.fromiter(chain.from_iterable(found), np.int64, 3 * len(found)).reshape(-1, 3)
                size, of = table[:, 2] - table[:, 1], np.repeat(np.arange(len(rows)), rows)
                upto = np.cumsum(size)
                base = np.concatenate(([0], np.cumsum(total)))[:-1][of] if len(rows) else size
                at = pa.array(of, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(k).take(at) for k in range(len(keep))], pa.array(table[:, 0], pa.int32()), pa.array(pieces, pa.string()), pa.array(table[:, 1]), pa.array(table[:, 2]), pa.array(upto - size - base), pa.array(np.array(total, np.int64)[of])],
                    names,
                )

    return spread(docs.select(*keep, F.col(text_col).alias("text to cut"))).mapInArrow(run, schema)


@lru_cache
def _signs(pattern: str):
    """Whether each code point is in the runs that a pattern finds."""
    import numpy as np

    found = np.zeros(0x110000, bool)
    for m in re.finditer(pattern, "".join(map(chr, range(0x110000)))):
        found[m.start() : m.end()] = True
    return found


def runs(docs: DataFrame, keep: list[str], text_col: str, pattern: str, by_place: bool = False, only: tuple[str, ...] = ("idx", "word", "start", "end_pos", "before", "total")) -> DataFrame:
    """As spans(), of the runs of signs that a pattern of one kind of sign finds; no sign is looked at by itself.

    idx counts the runs before each in its text, or by_place the other signs before it; `only` names the columns that are made.
    """
    names = [*keep, *only]
    kinds = {"idx": T.IntegerType(), "word": T.StringType()}
    schema = T.StructType([*(docs.schema[c] for c in keep), *[T.StructField(n, kinds.get(n, T.LongType())) for n in only]])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                texts = part.column(len(keep)).cast(pa.large_string()).fill_null("")
                ends_of = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
                data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends_of[0] : ends_of[-1]]
                if not len(data):
                    continue
                first = np.flatnonzero((data & 0xC0) != 0x80)  # where each sign's bytes begin
                width = np.diff(first, append=len(data))
                edge = np.searchsorted(first, ends_of - ends_of[0])  # the first sign of each text, and their number
                inside = _signs(pattern)[np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)]
                before, after = np.roll(inside, 1), np.roll(inside, -1)
                before[edge[edge < len(inside)]] = False
                after[edge[edge > 0] - 1] = False
                start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
                of = np.searchsorted(edge, start, "right") - 1
                size = end - start
                upto = np.concatenate(([0], np.cumsum(size)))
                lowest = np.searchsorted(of, np.arange(len(texts) + 1))  # the first run of each text, and their number
                letters = upto[:-1] - upto[lowest[of]]
                total = upto[lowest[1:]] - upto[lowest[:-1]]
                start, end = start - edge[of], end - edge[of]

                def word():
                    bytes_of = np.concatenate(([0], np.cumsum(width * inside)))[np.concatenate(([0], end + edge[of]))].astype(np.int32)
                    return pa.StringArray.from_buffers(len(of), pa.py_buffer(bytes_of), pa.py_buffer(data[np.repeat(inside, width)]))

                made = {
                    "idx": lambda: pa.array(start - letters if by_place else np.arange(len(of)) - lowest[of], pa.int32()), "word": word, "start": lambda: pa.array(start), "end_pos": lambda: pa.array(end),
                    "before": lambda: pa.array(letters), "total": lambda: pa.array(total[of]),
                }
                at = pa.array(of, pa.int32())
                yield pa.RecordBatch.from_arrays([*[part.column(k).take(at) for k in range(len(keep))], *[made[n]() for n in only]], names)

    return spread(docs.select(*keep, F.col(text_col).alias("text to cut"))).mapInArrow(run, schema)


def word_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., idx, word, start, end_pos, before, total): words of any script, end exclusive; before and total as in spans()."""
    return runs(docs, [id_col, *keep], text_col, _WORD)


def word_times(words: DataFrame, duration_ms: Column) -> DataFrame:
    """word_spans() with start_ms and end_ms: each word's share of the duration is its share of the letters, rounded to the millisecond."""
    at = lambda x: F.floor((x * duration_ms.cast("long") * 2 + F.col("total")).cast("decimal(38,0)") / (F.col("total") * 2)).cast("long")
    return words.withColumns({"start_ms": at(F.col("before")), "end_ms": at(F.col("before") + F.col("end_pos") - F.col("start"))}).drop("before", "total")


def chunk_times(words: DataFrame, chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Times of the words of chunks, each chunk's after those before it; chunks: (id, chunk, duration_ms), words have a chunk column."""
    order = Window.partitionBy(id_col).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.withColumn("offset_ms", F.coalesce(F.sum(F.greatest("duration_ms", F.lit(0))).over(order), F.lit(0)))
    size = F.length("word").cast("long")
    both, own = [id_col, "chunk"], Window.partitionBy(id_col, "chunk")
    timed = words.join(offsets, both).withColumns({"upto": F.sum(size).over(own.orderBy("idx")), "total": F.sum(size).over(own)})
    at = lambda x: F.col("offset_ms") + F.floor((x * F.col("duration_ms") * 2 + F.col("total")) / (F.col("total") * 2)).cast("long")
    return timed.withColumns({"start_ms": at(F.col("upto") - size), "end_ms": at(F.col("upto"))}).drop("upto", "total", "offset_ms", "duration_ms")


def _lines(text: str) -> list[tuple[int, int, int]]:
    out, at = [], 0
    for i, line in enumerate(text.split("\n")):
        out.append((i, at, at + len(line)))
        at += len(line) + 1
    return out


def line_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, text, start) of every line."""
    found = spans(docs, [id_col], text_col, _lines, "line text")
    return found.select(id_col, F.col("idx").alias("line"), F.col("line text").alias("text"), "start")


def space_word_spans(docs: DataFrame, keys: list[str], text_col: str = "text", only: tuple[str, ...] = ("idx", "word", "start", "end_pos")) -> DataFrame:
    """(keys..., idx, word, start, end_pos) of words between spaces, or `only` some of these; idx counts the spaces before a word."""
    return runs(docs, keys, text_col, _SPACED, True, only)
