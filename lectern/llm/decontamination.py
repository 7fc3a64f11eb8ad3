"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are runs of letters and digits (any character beyond ASCII counts as a letter) after A-Z are lower-cased. A window is `window`
consecutive words of a benchmark item, or the whole item if it has fewer. Of the k-gram hashes of each window the least is its
fingerprint, so any span of `window` words that a document shares with an item gives both the same fingerprint. Consecutive windows
often share theirs, which is kept once for all of them. Documents without a
benchmark fingerprint are left alone; in the others, the windows that carry one are extended to whole windows and compared word by
word. A document word inside any occurrence of a window is hit.

Every document window is compared with the one distinct window text that it can equal, so rows are linear in a document's length
however often a passage occurs on either side.

Edge cases (tests/llm/test_decontamination.py): null and empty texts have no words and no hits; items without words have no
windows; repeated documents keep one row each; items that repeat count once per item id and null item ids are left out; an empty
benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import forget, settle

WINDOW, GRAM = 13, 5
#: Distinct windows of the benchmark are broadcast up to so many (a few hundred bytes each); beyond, the joins are shuffled.
BROADCAST_ROWS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text, an empty array for null."""
    lowered = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.filter(F.split(lowered, BETWEEN), lambda w: w != ""), F.array().cast("array<string>"))


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fingerprints_of(words: Column, length: int, gram: int) -> Column:
    """array<struct<fingerprint, start, stop>>: the least gram hash of each window of `length` words, once for a run of windows.

    A run is of consecutive windows (start to stop, exclusive) with the same fingerprint; null for texts of fewer words.
    """
    gram = min(gram, length)
    span = length - gram + 1

    def windows(hashes: Column) -> Column:
        least = lambda i: F.least(*[F.get(hashes, i + j) for j in range(span)]) if span > 1 else F.get(hashes, i)
        return F.transform(F.sequence(F.lit(0), F.size(hashes) - span), least)

    def runs(found: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(found) - 1), lambda i: (i == 0) | (F.get(found, i) != F.get(found, i - 1)))
        run = lambda starts: F.transform(starts, lambda s, k: F.struct(F.get(found, s).alias("fingerprint"), s.alias("start"), F.coalesce(F.get(starts, k + 1), F.size(found)).alias("stop")))
        return _bound(first, run)

    starts = F.sequence(F.lit(0), F.size(words) - gram)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(gram)]))
    return F.when(F.size(words) >= length, _bound(_bound(hashes, windows), runs))


def _windows(items: DataFrame, item_id: str, item_text: str, window: int, gram: int) -> DataFrame:
    """(item_id, length, words) of every window of every item."""
    words = items.select(F.col(item_id).alias("item_id"), words_of(F.col(item_text)).alias("words")).where("size(words) > 0 AND item_id IS NOT NULL")
    words = words.withColumn("length", F.least(F.size("words"), F.lit(window)))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)
    return words.withColumn("start", F.explode(starts)).select("item_id", "length", F.slice("words", F.col("start"), F.col("length")).alias("words"))


def _hits(docs: DataFrame, items: DataFrame, text_col: str, item_id: str, item_text: str, window: int, gram: int) -> DataFrame:
    """(key, n_words, n_hit, hits, items) of every distinct text with hits, by its SHA-256; a stored table."""
    windows = settle(_windows(items, item_id, item_text, window, gram).distinct(), "windows")
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # at most `window` numbers
    if not lengths:
        return docs.sparkSession.createDataFrame([], "key string, n_words long, n_hit long, hits array<struct<start:int,end:int>>, items array<string>")

    texts = settle(windows.select("length", "words").distinct().withColumn("window_id", F.monotonically_increasing_id()), "texts")
    marked = reduce(lambda c, n: c.when(F.col("length") == n, F.get(fingerprints_of(F.col("words"), n, gram), 0)["fingerprint"]), lengths, F.when(F.lit(False), F.lit(0)))
    texts = settle(texts.withColumn("fingerprint", marked.cast("long")), "marked")
    owners = windows.join(texts, ["length", "words"]).select("window_id", F.col("item_id").cast("string").alias("item"))
    prints = texts.select("fingerprint").distinct()
    small = texts.count() <= BROADCAST_ROWS
    if small:
        prints, texts = F.broadcast(prints), F.broadcast(texts)
    if windows.count() <= BROADCAST_ROWS:
        owners = F.broadcast(owners)

    found_in = lambda words: F.array(*[F.struct(F.lit(n).alias("length"), fingerprints_of(words, n, gram).alias("found")) for n in lengths])
    key = F.sha2(F.col(text_col), 256)
    words = docs.select(key.alias("key"), words_of(F.col(text_col)).alias("words")).select("key", "words", F.explode(found_in(F.col("words"))).alias("at"))
    if small:  # no shuffle: words stay with their runs
        each = words.select("key", "words", "at.length", F.explode("at.found").alias("run")).select("key", "words", "length", "run.*").join(prints, "fingerprint", "left_semi")
    else:  # runs are shuffled by themselves, and meet one text of each key again, whole
        runs = words.select("key", "at.length", F.explode("at.found").alias("run")).select("key", "length", "run.*").join(prints, "fingerprint", "left_semi").distinct()
        runs = settle(runs.groupBy("key").agg(F.collect_list(F.struct("length", "fingerprint", "start", "stop")).alias("runs")), "runs")
        again = docs.select(key.alias("key"), F.col(text_col).alias("text")).join(runs.select("key"), "key", "left_semi").dropDuplicates(["key"])
        each = again.join(runs, "key").select("key", words_of(F.col("text")).alias("words"), "runs").select("key", "words", F.explode("runs").alias("run")).select("key", "words", "run.*")
    each = each.select("key", "words", "length", "fingerprint", F.explode(F.sequence("start", F.col("stop") - 1)).alias("start"))
    each = each.select("key", F.size("words").alias("n_words"), "length", "fingerprint", "start", F.slice("words", F.col("start") + 1, F.col("length")).alias("words"))
    found = settle(each.join(texts, ["length", "fingerprint", "words"]).select("key", "n_words", "start", (F.col("start") + F.col("length")).alias("end"), "window_id"), "found")

    hits = found.groupBy("key").agg(F.first("n_words").cast("long").alias("n_words"), F.array_sort(F.collect_set(F.struct("start", "end"))).alias("hits"))
    items = found.select("key", "window_id").distinct().join(owners, "window_id").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], acc["end"]))).alias("n"), F.greatest(acc["end"], x["end"]).alias("end"))
    hit = settle(hits.join(items, "key", "left").select("key", "n_words", F.aggregate("hits", zero, step)["n"].cast("long").alias("n_hit"), "hits", "items"), "hits")
    forget(found)
    return hit


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(id, n_words, n_hit, hits, items) for every row of docs.

    n_words, n_hit: words and hit words (long); hits: array<struct<start, end>>, the windows that occur, in order, by word, end
    exclusive; items: the ids of the items with windows that occur, as sorted strings.
    """
    hit = _hits(docs, items, text_col, item_id, item_text, window, gram)
    base = docs.select(F.col(id_col).alias("id"), F.sha2(F.col(text_col), 256).alias("key"), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    full = base.join(hit.drop("n_words"), "key", "left")
    return full.select("id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("hits", F.array()).alias("hits"), F.coalesce("items", F.array()).alias("items"))


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """Whether a twentieth of the words or more are hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def uncontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The rows of docs that are not contaminated, as they are."""
    hit = _hits(docs, items, text_col, item_id, item_text, window, gram)
    bad = settle(hit.where(is_contaminated(F.col("n_hit"), F.col("n_words"))).select(F.unhex("key").alias("contaminated text")), "contaminated")
    forget(hit)
    return docs.join(bad, F.unhex(F.sha2(F.col(text_col), 256)) == F.col("contaminated text"), "left_anti").select(*docs.columns)
