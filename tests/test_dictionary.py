"""Phrases by an automaton against a plain search, readings through joins, dictionaries in parts."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.functions import lexicon as L
from lectern.operators import dictionary as D
from lectern.plans import catalogue
from lectern.plans.normalize import normalize

WORD = re.compile(D.WORD)


def brute(text, terms, overlapping):
    """Every phrase of a dict {term: said} in a text, by trying each at each word."""
    words = [(m.start(), m.end(), m[0].lower()) for m in WORD.finditer(text or "")]
    found = []
    for i in range(len(words)):
        for term, said in terms.items():
            own = term.split()
            if [w for *_, w in words[i : i + len(own)]] == own and all(not text[words[k][1] : words[k + 1][0]].strip(" \t\n\r\x0b\x0c") for k in range(i, i + len(own) - 1)):
                found.append((words[i][0], words[i + len(own) - 1][1], term, said))
    return (D.longest_each if overlapping else D.leftmost_longest)(found)


def cases():
    rng = random.Random(6)
    vocabulary = ["a", "b", "c", "École", "d2", "x"]
    terms = {" ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 2, 3, 5]))).lower(): f"said {i}" for i in range(25)}
    docs = [(i, "".join(rng.choice(vocabulary).upper() + rng.choice([" ", " ", "\n", "  ", ", ", "-"]) for _ in range(rng.randint(0, 40)))) for i in range(60)]
    return docs + [(None, "a b c"), (3, "a b c"), (100, None), (101, "")], terms


def test_the_automaton_finds_all_occurrences():
    phrases = [["a"], ["a", "b"], ["b", "a", "b"], ["b"], ["a", "b", "a", "c"], [], ["a"]]
    words = list("abababacb")[:4] + [None] + list("abac")
    want = sorted((i, i + len(p), k) for k, p in enumerate(phrases[:5]) if p for i in range(len(words)) if words[i : i + len(p)] == p)
    assert sorted(D.Automaton(phrases).matches(iter(words))) == want


@pytest.mark.parametrize("overlapping", [False, True])
@pytest.mark.parametrize("part_chars", [D.PART_CHARS, 40])
def test_phrases_like_a_plain_search(spark, overlapping, part_chars):
    docs, terms = cases()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS found").repartition(3)
    given = [(f" {k.upper()}, " if i % 2 else k.replace(" ", "-"), v) for i, (k, v) in enumerate(terms.items())] + [(next(iter(terms)), "zzz"), ("--", "nothing"), (None, "x"), ("q", None)]
    got = D.find_phrases(df, spark.createDataFrame(given, "term string, said string"), overlapping=overlapping, part_chars=part_chars)
    want = [(k, *m) for k, text in docs for m in brute(text, terms, overlapping)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and want


def test_no_phrases(spark):
    docs, empty = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([], "term string, said string")
    assert D.find_phrases(docs, empty).count() == 0
    assert D.find_phrases(docs.limit(0), spark.createDataFrame([("a", "b")], "term string, said string")).count() == 0


def test_english_readings_in_their_order(spark):
    words = spark.createDataFrame([("Pull Request",), ("pull request",), ("API",), ("own",), ("Zed",), (None,), ("own",)], "word string")
    custom = spark.createDataFrame([("OWN", "моё"), ("own", "яяя"), ("api", "по-своему"), ("zed", None)], "term string, said string")
    got = {r.word: (r.said, r.by) for r in D.read_english(words, custom=custom).collect()}
    assert got == {"Pull Request": (L.PHRASES["pull request"], "phrase"), "pull request": (L.PHRASES["pull request"], "phrase"), "API": ("по-своему", "custom"), "own": ("моё", "custom"), "Zed": ("зед", "letters")}
    assert D.read_english(words.where("word = 'API'")).first().by == "term"
    rows = spark.createDataFrame([(1, "own"), (2, "Zed"), (3, "own")], "id int, word string")
    assert sorted((r.id, r.said) for r in D.say_words(rows, D.read_english(words, custom=custom)).collect()) == [(1, "моё"), (2, "зед"), (3, "моё")]


def test_abbreviations_in_their_order(spark):
    special, as_word = next(iter(L.SPECIAL_ABBREVIATIONS)), next(iter(L.AS_WORD))
    words = spark.createDataFrame([(special.upper(),), (as_word,), ("B",), ("XYZ",), ("a1",), ("5",)], "word string")
    got = {r.word: (r.said, r.by) for r in D.read_abbreviations(words).collect()}
    letters = lambda x: " ".join(L.LETTERS.get(c, c) for c in x)
    assert got == {special.upper(): (L.SPECIAL_ABBREVIATIONS[special], "special"), as_word: (L.AS_WORD[as_word], "as word"), "B": (L.LETTERS["b"], "spelled"), "XYZ": (letters("xyz"), "spelled"), "a1": (letters("a1"), "spelled"), "5": ("5", "spelled")}


def test_a_large_dictionary_reads_words_of_prose(spark):
    docs = spark.createDataFrame([(1, "Открой Widget77777 и gadget, API"), (2, "gadget")], "doc_id long, text string")
    terms = spark.range(100_000).select(F.concat(F.lit("gadget"), F.when(F.col("id") > 0, F.col("id").cast("string")).otherwise("")).alias("term"), F.concat(F.lit("гаджет"), F.col("id")).alias("said"))
    got = {r.doc_id: r.normalized for r in normalize(docs, dictionary=terms).collect()}
    assert got[2] == "гаджет0" and "гаджет0" in got[1]
    plain = {r.doc_id: r.normalized for r in normalize(docs).collect()}
    assert got[1].split(" ")[0] == plain[1].split(" ")[0] and plain[2] != got[2]


@pytest.mark.parametrize("name", ["phrase_matches", "english_readings"])
def test_queries_agree_with_their_sql(spark, name):
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, sf)
    want = con.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall()) and got.count()
