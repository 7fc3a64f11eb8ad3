import time

import pytest
from pyspark.sql import functions as F

from lectern.plans.normalize import char_map, cut, normalize, provenance
from lectern.plans import normalize as plan
from tests.golden_texts import CHAR_MAPS, GOLDEN

MORE = [
    ("a === b", "эй  строго равно  би"), ("x =>= y", "икс  толстая стрелка = вай"), ("﻿Привет﻿ мир", "Привет мир"), ("`α_x → b`", "альфа икс стрелка би"),
    ("```python\nx\n```\n<!-- my-code: brief -->\n```\ny\n```", "икс\n\nдалее следует блок кода"), ("40.13.2024", "сорок точка тринадцать точка две тысячи двадцать четыре"),
    ("99999999999999999999 и 7", "99999999999999999999 и семь"), ("[a](b) [c] (d) [](e)", "эй [си] (ди) [](и)"), ("C++ и c#", "си плюс плюс и си шарп"), ("~/x/../y", "тильда слэш кс слэш точка точка слэш и"),
]


@pytest.fixture(scope="module")
def read(spark):
    texts = [x for _, x, _ in GOLDEN] + [x for x, _ in MORE] + [None, "", " \n\t "]
    docs = spark.createDataFrame([(i, x, "c", 1) for i, x in enumerate(texts)], "doc_id long, text string, kind string, row int")
    return normalize(docs).cache()


def test_golden(read):
    got = {r.doc_id: r.normalized for r in read.select("doc_id", "normalized").collect()}
    wanted = [y for _, _, y in GOLDEN] + [y for _, y in MORE] + ["", "", ""]
    wrong = [(i, y, got[i]) for i, y in enumerate(wanted) if got[i] != y]
    assert not wrong


def test_char_maps(read):
    names = {name: i for i, (name, _, _) in enumerate(GOLDEN)}
    rows = {r.doc_id: [tuple(x) for x in r.char_map] for r in char_map(read).collect()}
    for name, wanted in CHAR_MAPS.items():
        assert rows[names[name]] == wanted, name
    for r in read.select("doc_id", "normalized").collect():
        assert len(rows[r.doc_id]) == len(r.normalized)


def test_parts_and_free_text_are_the_source(read):
    texts = [x for _, x, _ in GOLDEN] + [x for x, _ in MORE]
    for r in read.where(f"doc_id < {len(texts)}").collect():
        source, done = texts[r.doc_id], 0
        for p in r.parts:
            assert source[done : p.start] == p.free
            done = p.stop
        assert source[done:] == r.tail


def test_provenance(read):
    size = next(i for i, (name, _, _) in enumerate(GOLDEN) if name == "size_gb")
    source = GOLDEN[size][1]
    spans = provenance(read).where(f"doc_id = {size}").collect()
    assert [source[r.orig_start : r.orig_end] for r in spans] == ["5GB"]
    assert all(a.norm_end <= b.norm_start for a, b in zip(spans, spans[1:]))


def test_terms_are_a_parameter(spark):
    docs = spark.createDataFrame([(1, "zork and `zork_id`"), (None, "zork"), (None, "zork")], "doc_id long, text string")
    rows = sorted(r.normalized for r in normalize(docs, terms={"zork": "зорк!"}, code_terms={"zork": "код"}).collect())
    assert rows == ["зорк!", "зорк!", "зорк! анд код ай ди"]
    assert normalize(docs.limit(0)).count() == 0


def test_brief_mode(spark):
    docs = spark.createDataFrame([(1, "```rust\nfn x\n```"), (2, "<!-- any-code: full -->\n```\ny\n```")], "doc_id long, text string")
    assert {r.doc_id: r.normalized for r in normalize(docs, brief=True).collect()} == {1: "далее следует пример кода на раст", 2: "игрек"}


def test_cutting_takes_linear_time():
    line = "Раздел про getUserData, user_id и API v1.2.3 на https://example.com/path?q=1.\n- пункт 100MB, 50%, 10-20, α → β, `code_x` и [ссылка](http://a.ru) 12.05.2024 14:30\n"

    def seconds(size):
        text = line * (size // len(line))
        best = []
        for _ in range(3):
            began = time.process_time()
            cut(text)
            best.append(time.process_time() - began)
        return min(best)

    assert seconds(256_000) < 4 * seconds(128_000)
    for hard in ("[" * 200_000, "](" * 100_000, "`" * 200_000, "```x" * 50_000, "a-" * 20_000, "[[a](" * 50_000):
        began = time.process_time()
        cut(hard)
        assert time.process_time() - began < 20


def test_a_block_asks_once_for_what_its_texts_repeat(spark):
    docs = spark.range(1000).selectExpr("id AS doc_id", "concat('Take getUserData at 12:30 — ', id % 2, ' times') AS text")
    notes = plan.cut_documents(docs, "doc_id", "text").where("notes IS NOT NULL").select("block", F.explode("notes").alias("note")).collect()
    blocks = {r.block for r in notes}
    assert 0 < len(blocks) <= spark.sparkContext.defaultParallelism
    assert len(notes) <= 8 * len(blocks) and len(set(notes)) == len(notes)


def test_blocks_change_no_text(spark, monkeypatch):
    texts = [x for _, x, _ in GOLDEN] * 3 + [None, ""]
    docs = spark.createDataFrame([(i % 50, x) for i, x in enumerate(texts)], "doc_id long, text string").repartition(2)
    monkeypatch.setattr(plan, "BLOCK_SIGNS", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert plan.cut_documents(docs, "doc_id", "text").where("notes IS NOT NULL").count() > 10
        small = sorted(plan.spoken(docs).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    monkeypatch.undo()
    whole = normalize(docs).select("doc_id", "normalized", F.size("parts").alias("rewritten")).collect()
    assert small == sorted(whole) and len(small) == len(texts)


def test_packed_parts_are_the_parts():
    for text in ("", "ж" * 300 + " a " + "ж" * 70_000 + " `" + "b " * 200 + "`", " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600))):
        t = cut(text)
        start, stop, number = plan.unpacked(plan.packed(t))
        notes = list(t.notes)
        assert [(a, z, notes[k]) for a, z, k in zip(start.tolist(), stop.tolist(), number.tolist())] == t.parts()


def test_cutting_is_not_slowed_by_single_spaces_and_words_without_signs():
    text, calls = "plain words ж " * 2000, []
    counted = plan.Tracked.sub
    plan.Tracked.sub = lambda self, pattern, change: counted(self, pattern, lambda m: calls.append(m) or change(m))
    try:
        t = cut(text)
    finally:
        plan.Tracked.sub = counted
    assert len(t.parts()) == 4000 and not calls
