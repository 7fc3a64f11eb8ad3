"""Encoding by words and decoding by pieces, against the tokenizer itself on whole texts."""

import hashlib

import pytest
from tokenizers import Tokenizer

from lectern.llm import bpe, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def full():
    found = Tokenizer.from_file(queries.word_vocabulary())
    found.no_padding(), found.no_truncation()
    return found


TEXTS = [
    None, "", " \n\t ", "Hello, hello HELLO!", "it's 'tis don't we'll X's", "a<|endoftext|>b <|startoftext|> <|endoftext|", "ＡＢＣ naïve éa ́b ẞ İstanbul ΣΑΣ",
    "日本語 テスト 12 3.5 ½ ٣", "a b c\u0085d\x1ce\x0bf\x0cg", "x" * 5000, "word " * 3000, "\x00 null ﻿ \U0001F600\U0001F600!! ---", "it's 'tis don't we'll X's", "!'s ''s '' s'",
]


def expected(full, text):
    ids = full.encode(text or "", add_special_tokens=False).ids
    return ids, full.decode(ids, skip_special_tokens=False)


def test_ids_and_decoded_texts_are_the_tokenizers(spark, full):
    docs = spark.createDataFrame([(i if i else None, x, "en", 1) for i, x in enumerate(TEXTS)], "doc_id long, text string, ids string, block int").repartition(3)
    for chars in (20, bpe.BLOCK):
        got = {(r.id, tuple(r.ids), r.decoded) for r in bpe.encode(docs, queries.word_vocabulary(), decoded=True, block_chars=chars).collect()}
        assert got == {(i if i else None, tuple(expected(full, x)[0]), expected(full, x)[1]) for i, x in enumerate(TEXTS)}


def test_decoding_a_table_of_ids(spark, full):
    rows = [(1, [3306, 49407, 320]), (2, []), (3, None), (4, [320, None, -5, 10**6, 321]), (4, [320])]
    tokens = spark.createDataFrame(rows, "id long, ids array<int>")
    for size in (2, bpe.BLOCK_IDS):
        got = sorted((r.id, r.decoded) for r in bpe.decode(tokens, queries.word_vocabulary(), block_ids=size).collect())
        assert got == sorted((k, full.decode([x for x in ids or [] if x is not None and 0 <= x < 49408], skip_special_tokens=False)) for k, ids in rows)


def test_round_trip_of_ids(spark):
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(TEXTS)], "doc_id long, text string")
    both = {r.id: r.decoded for r in bpe.encode(docs, queries.word_vocabulary(), decoded=True).collect()}
    ids = bpe.encode(docs, queries.word_vocabulary())
    assert {r.id: r.decoded for r in bpe.decode(ids, queries.word_vocabulary()).collect()} == both


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(docs, queries.word_vocabulary(), decoded=True).count() == 0
    assert bpe.decode(spark.createDataFrame([], "id long, ids array<int>"), queries.word_vocabulary()).count() == 0


def test_a_tokenizer_that_does_not_go_by_words(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    other = Tokenizer.from_file(path)
    docs = spark.createDataFrame([(1, " two  words"), (2, "naïve\n\nx"), (3, None)], "doc_id long, text string")
    assert {r.id: r.ids for r in bpe.encode(docs, path).collect()} == {k: other.encode(x, add_special_tokens=False).ids for k, x in ((1, " two  words"), (2, "naïve\n\nx"), (3, ""))}


def test_the_query(spark, full):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids, text = expected(full, r.text)
        want[r.doc_id] = len(ids), sha(" ".join(map(str, ids))), sha(text)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op11_bpe(spark, SF).collect()}
    assert got == want
