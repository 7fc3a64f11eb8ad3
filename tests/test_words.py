import random
import re

from pyspark.sql import functions as F

from lectern.operators import words as W

TEXTS = [(1, "Привет, мир abc_1 — 你好!\nдва"), (2, ""), (3, None), (None, "a  b"), (None, "a  b"), (4, " \n x")]


def table(spark, rows=TEXTS):
    return spark.createDataFrame([(*r, 7, "w") for r in rows], "doc_id long, text string, idx int, word string")


def test_words_of_any_script(spark):
    rows = [(r.doc_id, r.idx, r.word, r.start, r.end_pos) for r in W.word_spans(table(spark)).collect()]
    assert sorted(r[1:] for r in rows if r[0] == 1) == [(0, "Привет", 0, 6), (1, "мир", 8, 11), (2, "abc_1", 12, 17), (3, "你好", 20, 22), (4, "два", 24, 27)]
    assert sorted(r[1:] for r in rows if r[0] is None) == [(0, "a", 0, 1)] * 2 + [(1, "b", 3, 4)] * 2
    assert not [r for r in rows if r[0] in (2, 3)]
    assert W.word_spans(table(spark, [])).count() == 0


def test_times_share_the_letters(spark):
    rows = W.word_times(W.word_spans(table(spark)), F.lit(1900)).where("doc_id = 1").orderBy("idx").collect()
    assert [(r.start_ms, r.end_ms) for r in rows] == [(0, 600), (600, 900), (900, 1400), (1400, 1600), (1600, 1900)]


def test_lines_and_words_between_spaces(spark):
    rows = [(r.doc_id, r.line, r.text, r.start) for r in W.line_spans(table(spark)).collect()]
    assert sorted(r[1:] for r in rows if r[0] == 4) == [(0, " ", 0), (1, " x", 2)]
    assert [r[1:] for r in rows if r[0] == 2] == [(0, "", 0)] and not [r for r in rows if r[0] == 3]
    rows = W.space_word_spans(table(spark), ["doc_id"]).where("doc_id IS NULL").distinct().orderBy("start").collect()
    assert [(r.idx, r.word, r.start, r.end_pos) for r in rows] == [(0, "a", 0, 1), (2, "b", 3, 4)]


def test_runs_like_a_loop_over_matches(spark):
    r = random.Random(4)
    texts = [None, "", "a", " ", "  ж", "мир\n", *("".join(r.choices("ab_é你😀 \u2003\n.́9\0", k=r.randint(0, 60))) for _ in range(700))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").repartition(3)
    got = {}
    for x in W.word_spans(df).orderBy("doc_id", "idx").collect():
        got.setdefault(x.doc_id, []).append(tuple(x)[1:])
    spaced = {}
    for x in W.space_word_spans(df, ["doc_id"]).orderBy("doc_id", "start").collect():
        spaced.setdefault(x.doc_id, []).append(tuple(x)[1:])
    for i, t in enumerate(texts):
        found = list(re.finditer(r"\w+", t or ""))
        sizes = [len(m[0]) for m in found]
        assert got.get(i, []) == [(k, m[0], m.start(), m.end(), sum(sizes[:k]), sum(sizes)) for k, m in enumerate(found)]
        assert spaced.get(i, []) == [(t[: m.start()].count(" "), m[0], m.start(), m.end()) for m in re.finditer("[^ ]+", t or "")]


def test_signs_are_those_of_the_pattern():
    for pattern in (W._WORD, W._SPACED):
        signs = W._signs(pattern)
        assert all(bool(re.fullmatch(pattern, chr(c))) == signs[c] for c in [*range(3000), *random.Random(1).sample(range(0x110000), 3000)])
