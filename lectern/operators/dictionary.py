"""Dictionaries of any size: phrases found in texts by an automaton, words and abbreviations read through joins.

A dictionary is a table (term, said). For phrases its terms are cut into words and dealt to parts of about PART_CHARS characters; a task
holds the automaton of one part, a trie over words with failure links, and reads each text once a part, in time linear in its words.
Matches of all parts come together by text, where the longest from the left stays. Readings of words are joined: different words once,
then back to their rows, which adaptive execution splits where a word is common.

Edge cases (tests/test_dictionary.py): null and empty texts match nothing; terms are compared without regard to case, by runs of letters
and digits, and white space alone may lie between a phrase's words; terms without words match nothing; of equal terms the one whose
reading is least counts; an empty dictionary or table gives no matches; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import lexicon as L
from lectern.functions.strings import letter_name, spell, transliterate
from lectern.session import settle, spread

#: Characters of the terms of a part of a dictionary, which a task holds.
PART_CHARS = 16_000_000
WORD = "[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"
_TOKEN = re.compile(f"({WORD})|([^ \t\n\r\x0b\x0c])")


class Automaton:
    """All places where phrases of words occur: states are prefixes of phrases, and a failure leads to the longest one that still fits."""

    def __init__(self, phrases: list[list[str]]):
        self.next: list[dict[str, int]] = [{}]
        self.ends, self.depth = [-1], [0]  # the phrase that a state completes, and its number of words
        for number, words in enumerate(phrases):
            state = 0
            for w in words:
                if w not in self.next[state]:
                    self.next[state][w] = len(self.next)
                    self.next.append({})
                    self.ends.append(-1)
                    self.depth.append(self.depth[state] + 1)
                state = self.next[state][w]
            if state and self.ends[state] < 0:
                self.ends[state] = number
        self.fail, self.shorter = [0] * len(self.next), [0] * len(self.next)
        row = list(self.next[0].values())
        for state in row:  # grows level by level
            for w, child in self.next[state].items():
                back = self.fail[state]
                while back and w not in self.next[back]:
                    back = self.fail[back]
                self.fail[child] = self.next[back].get(w, 0)
                row.append(child)
            back = self.fail[state]
            self.shorter[state] = back if self.ends[back] >= 0 else self.shorter[back]  # the next shorter phrase that ends here

    def matches(self, words: Iterator[str | None]) -> Iterator[tuple[int, int, int]]:
        """(first word, word behind the last, phrase) of every occurrence; None among the words starts anew."""
        state = 0
        for i, w in enumerate(words):
            if w is None:
                state = 0
                continue
            while state and w not in self.next[state]:
                state = self.fail[state]
            state = self.next[state].get(w, 0)
            at = state if self.ends[state] >= 0 else self.shorter[state]
            while at:
                yield i + 1 - self.depth[at], i + 1, self.ends[at]
                at = self.shorter[at]


def words_of(term: Column) -> Column:
    return F.regexp_extract_all(F.lower(term), F.lit(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"), F.lit(0))


def phrase_parts(dictionary: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """(part, term, said) in a stored table: each term once, its words joined by spaces, dealt to parts of about part_chars characters."""
    terms = dictionary.select(F.array_join(words_of(F.col("term")), " ").alias("term"), "said").where("term <> '' AND said IS NOT NULL").groupBy("term").agg(F.min("said").alias("said"))
    terms = settle(terms, "terms")
    total = terms.agg(F.sum(F.length("term") + F.length("said"))).first()[0] or 0
    return terms.withColumn("part", F.pmod(F.xxhash64("term"), F.lit(max(1, -(-total // part_chars)))))


def leftmost_longest(matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (start, stop, ...) those that remain if the first, and of these the longest, is taken again and again."""
    out, done = [], 0
    for m in sorted(matches, key=lambda m: (m[0], -m[1])):
        if m[0] >= done:
            out.append(m)
            done = m[1]
    return out


def longest_each(matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The longest at each start."""
    out: dict[int, tuple] = {}
    for m in matches:
        if m[0] not in out or m[1] > out[m[0]][1]:
            out[m[0]] = m
    return [out[k] for k in sorted(out)]


def find_phrases(docs: DataFrame, dictionary: DataFrame, id_col: str = "doc_id", text_col: str = "text", overlapping: bool = False, part_chars: int = PART_CHARS) -> DataFrame:
    """(id, start, end, term, said) of the phrases of a dictionary (term, said) in every row of docs; places are code points.

    The longest phrase from the left stays; with `overlapping`, the longest one at each place.
    """
    parts = phrase_parts(dictionary, part_chars)
    rows = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select(F.monotonically_increasing_id().alias("row"), "id", "text")
    kind = docs.schema[id_col].dataType
    listed = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("said", T.StringType())]))
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", kind), T.StructField("found", listed)])
    keep = longest_each if overlapping else leftmost_longest

    def scan(terms: list[str], said: list[str], last: bool) -> DataFrame:
        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            automaton = Automaton([x.split(" ") for x in terms])
            struct = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string()), ("said", pa.string())]))
            for batch in batches:
                found = []
                for text in batch.column(2).to_pylist():
                    tokens = list(_TOKEN.finditer(text or ""))
                    matches = automaton.matches(m[1].lower() if m[1] else None for m in tokens)
                    matches = keep(list(matches)) if last else longest_each(list(matches)) if overlapping else list(matches)
                    found.append([{"start": tokens[a].start(), "end": tokens[z - 1].end(), "term": terms[k], "said": said[k]} for a, z, k in matches])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, struct)], ["row", "id", "found"])

        return rows.mapInArrow(run, schema)

    numbers = [r.part for r in parts.select("part").distinct().orderBy("part").collect()]
    scans = []
    for part in numbers:
        held = parts.where(F.col("part") == part).select("term", "said").collect()  # about part_chars characters
        scans.append(scan([r.term for r in held], [r.said for r in held], len(numbers) == 1))
    if not scans:
        return docs.select(F.col(id_col).alias("id"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("term"), F.lit("").alias("said")).limit(0)
    found = scans[0]
    if len(scans) > 1:
        numbered = settle(reduce(DataFrame.unionByName, scans).where(F.size("found") > 0), "matches")
        together = numbered.groupBy("row").agg(F.first("id").alias("id"), F.flatten(F.collect_list("found")).alias("found"))

        def settle_matches(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                lists = [keep([(m["start"], m["end"], m) for m in found]) for found in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([[m for *_, m in x] for x in lists], batch.schema.field(2).type)], ["row", "id", "found"])

        found = together.mapInArrow(settle_matches, schema)
    return found.select("id", F.explode("found").alias("m")).select("id", "m.start", "m.end", "m.term", "m.said")


def _table(spark, values: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(values.items()), "term string, said string")


def _joined(words: DataFrame, tables: dict[str, DataFrame], fallback: Column, other: str) -> DataFrame:
    """(word, said, by): the first of the tables that has the lower-cased word says it, else the fallback."""
    words = words.withColumn("low", F.lower("word"))
    for name, table in tables.items():
        one = table.where("said IS NOT NULL").groupBy(F.lower("term").alias("low")).agg(F.min("said").alias(f"of {name}"))
        words = words.join(one, "low", "left")
    found = [F.when(F.col(f"of {name}").isNotNull(), F.struct(F.col(f"of {name}").alias("said"), F.lit(name).alias("by"))) for name in tables]
    return words.withColumn("x", F.coalesce(*found, F.struct(fallback.alias("said"), F.lit(other).alias("by")))).select("word", "x.said", "x.by")


def read_english(words: DataFrame, phrases: DataFrame | None = None, custom: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
    """(word, said, by) for the different words or phrases of a table (word): a phrase, a term of one's own, a known term, else transliterated.

    `by` is phrase, custom, term or letters; those by letters are the unknown words. Phrases and terms default to the library's own.
    """
    spark = words.sparkSession
    tables = {"phrase": _table(spark, L.PHRASES) if phrases is None else phrases, "custom": custom, "term": _table(spark, L.TERMS) if terms is None else terms}
    different = words.select("word").where("word IS NOT NULL").distinct()
    return _joined(different, {k: t for k, t in tables.items() if t is not None}, transliterate(F.lower("word")), "letters")


def read_abbreviations(words: DataFrame, special: DataFrame | None = None, as_word: DataFrame | None = None) -> DataFrame:
    """(word, said, by) for the different abbreviations of a table (word): a special reading, one as a word, a letter's name, else spelled."""
    spark = words.sparkSession
    tables = {"special": _table(spark, L.SPECIAL_ABBREVIATIONS) if special is None else special, "as word": _table(spark, L.AS_WORD) if as_word is None else as_word}
    different = words.select("word").where("word IS NOT NULL").distinct()
    said = F.when(F.length("word") == 1, F.coalesce(letter_name(F.col("word")), F.col("word"))).otherwise(spell(F.col("word")))
    return _joined(different, tables, said, "spelled")


def say_words(rows: DataFrame, readings: DataFrame, column: str = "word") -> DataFrame:
    """rows with `said` and `by` of their word; on complements of hashes, so that adaptive execution can split common words."""
    key = lambda c: F.bitwise_not(F.xxhash64(c))
    known = readings.select(key("word").alias("key"), F.col("word").alias("known word"), "said", "by")
    return rows.withColumn("key", key(column)).join(known, "key").where(F.col(column) == F.col("known word")).drop("key", "known word")

