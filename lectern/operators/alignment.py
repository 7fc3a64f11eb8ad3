"""Times of symbols and words from frame counts, and the reading of model outputs given as columns.

Edge cases (tests/test_alignment.py): symbols without frames take no time; chunks with a negative duration count as zero; empty arrays
give nulls or empty arrays; ties go to the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Seconds of a frame: 600 samples of 48 kHz.
FRAME_SECONDS = 600 / 48000


def symbol_times(symbols: DataFrame, keys: list[str], frames: str = "frames") -> DataFrame:
    """symbols (keys, i, ch, frames) with start and end in seconds from the start of their chunk: a running sum of frames."""
    upto = F.sum(frames).over(Window.partitionBy(*keys).orderBy("i"))
    return symbols.withColumns({"start": (upto - F.col(frames)) * FRAME_SECONDS, "end": upto * FRAME_SECONDS})


def chunk_offsets(chunks: DataFrame, key: str) -> DataFrame:
    """chunks (key, chunk, duration_sec) with offset_sec: the durations before, negative ones as zero."""
    before = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("offset_sec", F.coalesce(F.sum(F.greatest("duration_sec", F.lit(0.0))).over(before), F.lit(0.0)))


def word_times_of_symbols(words: DataFrame, symbols: DataFrame, keys: list[str]) -> DataFrame:
    """words (keys, idx, first, last) with start and end: the hull of the symbols from first to last, whose i lie in the word.

    Symbols carry their word's range, so this is an equi-join on the chunk with a range condition and one aggregate; a word none of
    whose symbols has frames starts and ends where the symbols before it end.
    """
    timed = symbol_times(symbols, keys).select(*keys, "i", F.col("start").alias("from"), F.col("end").alias("to"))
    joined = words.join(timed, keys, "left")
    inside = F.col("i").between(F.col("first"), F.col("last"))
    before = F.coalesce(F.max(F.when(F.col("i") < F.col("first"), F.col("to"))), F.lit(0.0))
    found = joined.groupBy(*words.columns).agg(F.min(F.when(inside, F.col("from"))).alias("lo"), F.max(F.when(inside, F.col("to"))).alias("hi"), before.alias("before"))
    return found.select(*words.columns, round_ms(F.coalesce("lo", "before")).alias("start"), round_ms(F.coalesce("hi", "before")).alias("end"))


def round_ms(seconds: Column) -> Column:
    """Seconds to three places, halves away from zero."""
    return F.round(seconds, 3)


def stage_totals(timings: DataFrame, stages: list[str], keys: list[str]) -> DataFrame:
    """The sum of each stage's seconds by key."""
    return timings.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in stages])


def softmax(logits: Column) -> Column:
    """Shares of exp(x), shifted by the greatest so that none overflows; null for an empty array."""
    top = F.array_max(logits)
    weights = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(logits) > 0, F.transform(weights, lambda w: w / total))


def argmax(values: Column) -> Column:
    """Position, from 0, of the first greatest value; null for an empty array."""
    return F.when(F.size(values) > 0, F.array_position(values, F.array_max(values)) - 1)


def over_threshold(values: Column, least: float) -> Column:
    """Positions, from 0, of the values of at least `least`."""
    return F.filter(F.transform(values, lambda v, i: F.when(v >= least, i)), lambda i: i.isNotNull())


def mean_embeddings(bags: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """(key, mean array<double>) of the vectors of each key's ids; bags: (key, id), vectors: (id, vector). Unknown ids count for nothing.

    Sums run by key and dimension, so a bag of any size is summed where it is read.
    """
    each = bags.join(vectors, "id").select(key, F.posexplode("vector").alias("d", "x"))
    means = each.groupBy(key, "d").agg(F.avg("x").alias("x"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("mean"))


def unknown_words(words: DataFrame, known: DataFrame, reading: Column) -> DataFrame:
    """(word, n, reading) of the words that no dictionary holds, read once each; words and known: (word)."""
    missing = words.groupBy("word").agg(F.count("*").alias("n")).join(known.select("word").distinct(), "word", "left_anti")
    return missing.withColumn("reading", reading)


def ingest_decision(text: Column, html: Column, html_text: Column) -> Column:
    """What is stored of a clipboard: html where its text says something, else the plain text, else nothing."""
    said = lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""
    return F.when(html.isNotNull() & said(html_text), "html").when(said(text), "direct").otherwise("reject")


def in_range(value: Column, low: float, high: float) -> Column:
    """struct<type, message> for a setting out of its range, null for one within."""
    bad = ~F.coalesce(value.between(low, high), F.lit(False))
    return F.when(bad, F.struct(F.lit("config_error").alias("type"), F.lit(f"not from {low} to {high}").alias("message")))
