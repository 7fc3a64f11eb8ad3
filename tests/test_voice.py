import re

import numpy as np
from pyspark.sql import functions as F

from lectern.functions import strings as S
from lectern.operators import extraction as X
from lectern.operators import samples as A
from lectern.operators import voice as V


def texts(spark, *rows):
    return spark.createDataFrame([(i, t, "w") for i, t in enumerate(rows)], "doc_id long, t string, word string")


def test_accent_tokens(spark):
    rows = [r[0] for r in texts(spark, "Кто-то  сказал: да-", "", None, " - ").select(V.accent_tokens(F.col("t"), ("то",))).collect()]
    assert [tuple(x) for x in rows[0]] == [("Кто-", "кто", True), ("то", "то", False), ("  ", "", False), ("сказал:", "сказал", True), (" ", "", False), ("да-", "да", True)]
    assert rows[1] == [] and rows[2] is None
    assert "".join(x.raw for x in rows[3]) == " - "


def test_marks_of_words():
    none = (None,) * 6
    assert V.mark_word("Ёлка", *none) == "+Ёлка" and V.mark_word("трёхё", *none) == "тр+ёх+ё" and V.mark_word("+ёлка", *none) == "+ёлка"
    assert V.mark_word("ДОМ,", *none) == "Д+ОМ," and V.mark_word("мама", *none) == "мама" and V.mark_word("с", *none) == "с"
    assert V.mark_word("Еще", 2, 2, *none[2:]) == "Ещ+ё" and V.mark_word("мама", 3, -1, *none[2:]) == "мам+а" and V.mark_word("аб", 9, None, *none[2:]) == "аб"
    assert V.mark_word("еще+", 2, 2, *none[2:]) == "ещё+" and V.mark_word("+еще", 2, 2, *none[2:]) == "+еще"
    guess = lambda w, *g: V.mark_word(w, None, None, *g)
    assert guess("замок", 1, 0.9, 0, 0.9) == "зам+ок" and guess("замок", 1, 0.5, 0, 0.9) == "замок" and guess("замок", 7, 0.9, 0, 0.9) == "замок"
    assert guess("веселый", 1, 0.9, 2, 0.9) == "вес+ёлый" and guess("ВЕСЕЛЫЙ", 1, 0.9, 2, 0.9) == "ВЕС+ЁЛЫЙ"
    assert guess("веселый", 0, 0.9, 2, 0.9) == "в+еселый" and guess("веселый", 1, 0.9, 2, 0.5) == "вес+елый" and guess("веселый", 1, 0.9, 9, 0.9) == "вес+елый"
    assert guess("вес+елый", 0, 0.9, 2, 0.9) == "вес+ёлый"


def test_texts_with_marks(spark):
    said = ["Открыть зам+ок было непросто.", "", None, "Открыть зам+ок было непросто.", "кто-то ещё"]
    exceptions = spark.createDataFrame([("было", 1, -1), ("было", 3, -1)], "word string, stress int, yo int")
    answers = spark.createDataFrame([("открыть", 1, 0.9, 0, 0.9), ("непросто", 1, 0.8, 0, 0.9), ("кто", 0, 0.9, 0, 0.1)], "word string, vowel int, chance double, yo int, yo_chance double")
    df = texts(spark, *said).withColumnRenamed("t", "text").withColumn("key", F.lit(1)).withColumn("raw", F.lit("x"))
    rows = V.accentuate(df, exceptions, answers, stop_words=("то",)).orderBy("doc_id").collect()
    assert [r.voiced for r in rows] == ["Откр+ыть зам+ок б+ыло непр+осто.", "", None, "Откр+ыть зам+ок б+ыло непр+осто.", "кт+о-то ещ+ё"]
    assert rows[0].word == "w" and rows[0].key == 1
    assert V.accentuate(df.limit(0), exceptions, answers.limit(0)).count() == 0
    long = "мама мыла " * 20000
    assert [r.voiced for r in V.accentuate(texts(spark, long), exceptions.limit(0), answers, "t").collect()] == [long]


def test_ngram_ids(spark):
    ngrams = spark.createDataFrame([("<", 0), ("а", 1), ("аб", 2), ("<аб>", 3), ("б", 4), ("б", 9)], "gram string, id long")
    words = spark.createDataFrame([("аб",), ("аб",), ("в",), ("",), (None,), ("а" * 5000,)], "word string")
    found = {r.word: r.ids for r in V.ngram_ids(words, ngrams, 7).collect()}
    assert found["аб"] == [0, 1, 4, 2, 3] and found["в"] == [0] and found[""] == [0] and found["а" * 5000] == [0] + [1] * 5000 and len(found) == 4
    assert {r.word: r.ids for r in V.ngram_ids(words.where("length(word) < 9"), ngrams.limit(0), 7).collect()} == {"аб": [7], "в": [7], "": [7]}
    assert spark.range(1).select(V.bag_offsets(F.array(*[F.array(*map(F.lit, x)) for x in ([5, 6], [7], [8, 9])]))).first()[0] == [0, 2, 3]


def test_homographs(spark):
    known = spark.createDataFrame([("замок", ["зам+ок", "з+амок"]), ("все", ["вс+ё", "вс+е"])], "word string, variants array<string>")
    df = texts(spark, "ЗАМОК и Все, замок2", None, "", "нет ++")
    found = V.homograph_words(df, known, text_col="t").orderBy("start").collect()
    assert [(r.word, r.start, r.end_pos, r.variants) for r in found] == [("ЗАМОК", 0, 5, ["з+амок", "зам+ок"]), ("Все", 8, 11, ["вс+е", "вс+ё"]), ("замок", 13, 18, ["з+амок", "зам+ок"])]
    marked = df.where("doc_id = 0").select(V.marked_homograph(F.col("t"), F.lit(8), F.lit(11))).first()[0]
    assert marked == "ЗАМОК и  [HOMO] Все [/HOMO] , замок2"
    picks = spark.createDataFrame([(["a", "b"], x) for x in (-1.0, 0.0, 1.0)] + [(["a"], 3.0)], "v array<string>, x double")
    assert [r[0] for r in picks.select(V.choose_variant(F.col("v"), F.col("x"))).collect()] == ["a", "a", "b", None]
    assert V.splice("ЗАМОК и Все", [(8, 11, "вс+ё"), (0, 5, "з+амок")]) == "З+АМОК и Вс+ё"
    assert V.splice("все", [(0, 3, None)]) == "все" and V.splice("все", [(0, 3, "все")]) == "все"
    choices = F.when(F.col("doc_id") == 0, F.array(F.struct(F.lit(8).alias("start"), F.lit(11).alias("end_pos"), F.lit("вс+ё").alias("variant"))))
    assert [r[0] for r in df.orderBy("doc_id").select(V.resolve_homographs(F.col("t"), choices)).collect()] == ["ЗАМОК и Вс+ё, замок2", None, "", "нет ++"]


def test_basic_tokens(spark):
    rows = texts(spark, "Привет, [HOMO] мир!\u200b\x00 a_b [x]\u3000你好\ufffd", "", None).select(S.basic_tokens(F.col("t"), ("[HOMO]",))).collect()
    assert [r[0] for r in rows] == [["Привет", ",", "[HOMO]", "мир", "!", "a", "_", "b", "[", "x", "]", "你", "好"], [], None]


def test_places_of_rendered_tokens(spark):
    assert X.place_tokens("# a **b a** &amp; c", ["a", "b a", "&", None, "zz", "c"]) == [("a", 2, 3), ("b", 6, 7), ("a", 8, 9), ("&", 12, 13), ("c", 18, 19)]
    df = spark.createDataFrame([("😀 a a", ["a", "a"]), (None, ["a"]), ("a", None)], "s string, t array<string>")
    assert [r[0] and [tuple(x) for x in r[0]] for r in df.select(X.token_places(F.col("s"), F.col("t"))).collect()] == [[("a", 2, 3), ("a", 4, 5)], None, None]


def test_lowest_band(spark):
    filters = A.band_filter(*A.BANDS[8000])
    assert filters.shape == (6, 63)
    clip = np.sin(np.arange(600) * 0.02)
    by_hand = [sum(filters[0][j] * (clip[6 * k + j - 31] if 0 <= 6 * k + j - 31 < 600 else 0) for j in range(63)) for k in range(100)]
    assert np.allclose(A.lowest_band(clip * 0.1, filters), np.array(by_hand) * 0.1)
    loud = A.lowest_band(clip * 9, filters)
    assert np.allclose(loud, np.tanh(np.array(by_hand) * 9))
    df = spark.createDataFrame([(clip.tolist(),), ([],), (None,), ([0.5],)], "s array<double>")
    assert [r[0] and len(r[0]) for r in df.select(A.to_lowest_band(F.col("s"), 8000)).collect()] == [100, [], None, 1]


def test_inverse_transform_is_exact(spark):
    hop, size = 16, 64
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    clip = np.random.default_rng(1).normal(size=hop * 20)
    padded = np.concatenate((np.zeros(24), clip, np.zeros(24)))
    spectra = np.fft.rfft([padded[k * hop : k * hop + size] * window for k in range(20)], axis=1).T
    size_of = np.abs(spectra)
    unit = spectra / np.where(size_of == 0, 1, size_of)
    assert np.allclose(A.inverse_transform(size_of, unit.real, unit.imag, hop), clip)
    df = spark.createDataFrame([(size_of.tolist(), unit.real.tolist(), unit.imag.tolist()), (None, None, None)], "m array<array<double>>, x array<array<double>>, y array<array<double>>")
    rows = [r[0] for r in df.select(A.samples_of_spectra(F.col("m"), F.col("x"), F.col("y"), hop)).collect()]
    assert np.allclose(rows[0], clip) and rows[1] == []


def test_tokens_are_counted_before_they_are_cleaned(spark):
    texts = spark.createDataFrame([("Кто-то, где +то", ), ("кто-то 5",), (None,), ("",)], "text string")
    got = {(r.raw, r.clean, r.placed): r.n for r in V.counted_tokens(texts, "text").collect()}
    each = texts.select(F.explode(V.accent_tokens(F.col("text"))).alias("x")).select("x.*").groupBy("raw", "clean", "placed").count().collect()
    assert got == {tuple(r)[:3]: r["count"] for r in each} and got[" ", "", False] == 3
    plan = V.counted_tokens(texts, "text")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Aggregate \[raw#\d+L?\], ", plan)  # by raw alone, so only its results are cleaned


def test_a_block_asks_for_a_word_once(spark):
    df = texts(spark, "мама мыла раму. " * 50, "мама и-и мыла", None, "").withColumn("voiced", F.lit("old")).coalesce(1)
    blocks = V._blocks(df, "t")
    assert blocks.where("row IS NOT NULL").count() == 4
    asked = [raw for r in blocks.where("row IS NULL").collect() for raw in r.raws]
    assert len(asked) < 30, asked
    answers = spark.createDataFrame([("мама", 0, 0.9, 0, 0.1), ("и", 0, 0.9, 0, 0.1)], "word string, vowel int, chance double, yo int, yo_chance double")
    none = spark.createDataFrame([], "word string, stress int, yo int")
    rows = V.accentuate(df, none, answers, "t", stop_words=("и",)).orderBy("doc_id").collect()
    assert [r.voiced for r in rows] == ["м+ама мыла раму. " * 50, "м+ама +и-и мыла", None, ""]


def test_rendered_tokens_come_as_rows_from_arrow(spark):
    from lectern.plans.voice_queries import rendered_tokens

    df = rendered_tokens(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "Repartition" in plan  # no arrays of structs, and small tables are spread
    assert df.dtypes == [("doc_id", "bigint"), ("word", "string"), ("start", "int"), ("end", "int")]
