import pytest
from pyspark.sql import functions as F

from lectern.operators import alignment as A


def test_symbol_and_word_times(spark):
    symbols = spark.createDataFrame([(1, i, c, n) for i, (c, n) in enumerate([("a", 4), ("b", 4), (" ", 8), ("c", 0), ("d", 16)])], "chunk int, i int, ch string, frames int")
    rows = A.symbol_times(symbols, ["chunk"]).orderBy("i").collect()
    assert [(r.start, r.end) for r in rows] == [(0.0, 0.05), (0.05, 0.1), (0.1, 0.2), (0.2, 0.2), (0.2, 0.4)]
    words = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 3, 4), (1, 2, 9, 9)], "chunk int, idx int, first int, last int")
    found = A.word_times_of_symbols(words, symbols, ["chunk"]).orderBy("idx").collect()
    assert [(r.start, r.end) for r in found] == [(0.0, 0.1), (0.2, 0.4), (0.4, 0.4)]


def test_chunk_offsets(spark):
    chunks = spark.createDataFrame([("e", 0, 1.5), ("e", 1, -2.0), ("e", 2, 1.0)], "id string, chunk int, duration_sec double")
    assert [r.offset_sec for r in A.chunk_offsets(chunks, "id").orderBy("chunk").collect()] == [0.0, 1.5, 1.5]


def test_model_outputs(spark):
    row = spark.createDataFrame([([1.0, 3.0, 3.0], [])], "x array<double>, e array<double>")
    got = row.select(A.softmax(F.col("x")).alias("s"), A.argmax(F.col("x")).alias("a"), A.over_threshold(F.col("x"), 2.0).alias("o"), A.softmax(F.col("e")).alias("se"), A.argmax(F.col("e")).alias("ae")).first()
    assert sum(got.s) == pytest.approx(1) and got.s[1] == got.s[2] > got.s[0]
    assert got.a == 1 and got.o == [1, 2] and got.se is None and got.ae is None


def test_mean_embeddings(spark):
    bags = spark.createDataFrame([("w", 1), ("w", 2), ("w", 9), ("v", 1)], "word string, id int")
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 6.0])], "id int, vector array<double>")
    assert {r.word: r["mean"] for r in A.mean_embeddings(bags, vectors, "word").collect()} == {"w": [2.0, 4.0], "v": [1.0, 2.0]}


def test_unknown_words(spark):
    words = spark.createDataFrame([("a",), ("b",), ("b",)], "word string")
    known = spark.createDataFrame([("a",)], "word string")
    assert [tuple(r) for r in A.unknown_words(words, known, F.upper("word")).collect()] == [("b", 2, "B")]


def test_decisions(spark):
    rows = spark.createDataFrame([("t", "<p>x</p>", "x"), ("t", "<i></i>", " "), (" ", None, None), (None, None, None)], "t string, h string, ht string")
    assert [r[0] for r in rows.select(A.ingest_decision(F.col("t"), F.col("h"), F.col("ht"))).collect()] == ["html", "direct", "reject", "reject"]
    speeds = spark.createDataFrame([(0.5,), (2.1,), (None,)], "s double").select(A.in_range(F.col("s"), 0.5, 2.0).alias("e")).collect()
    assert [r.e and r.e.type for r in speeds] == [None, "config_error", "config_error"]
