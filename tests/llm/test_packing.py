import random
import zlib

import pytest
from pyspark.sql import Row

from lectern.llm import packing
from lectern.llm.queries import word_vocabulary


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(word_vocabulary())


TEXTS = [
    None, "", " \n\t ", "Hello, World. It's don't Été naïve ΣΣΣ. été", "<|endoftext|> and <|ENDOFTEXT|>, x<|startoftext|>.", "a.b,c.. d,, ,. . 12,5 1999.",
    "tab\tcr\rff\x0cnbsp em us\x1fx", "你好，世界. \U0001f600, word́.", "word " * 9000, "unbroken" * 2000, "'s 'T 'll, we'll.", "İstanbul ß ẞ, ǅ.", "— —, 12, e\u0301, e\u0301\u0301,, \u0301, x_y_ _, d'été*** ÀÉ; \u212bm, \u212a&&&.",
]


def rebuilt(rows, tokenizer, window):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for k, pieces in by_doc.items():
        ids = [*(tokenizer.encode(TEXTS[k] or "", add_special_tokens=False).ids), 2]
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.ids == ids[at : at + r.length] and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r.ids))
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return by_sequence


def test_round_trip(spark, tokenizer):
    docs = spark.createDataFrame([Row(doc_id=i, text=x, length="n", group="g") for i, x in enumerate(TEXTS)], "doc_id long, text string, length string, group string")
    rows = packing.pack_documents(docs, word_vocabulary(), window=64, with_ids=True).collect()
    assert {r.id for r in rows} == set(range(len(TEXTS)))
    rebuilt(rows, tokenizer, 64)


def test_little_padding(spark):
    r = random.Random(1)
    pieces = spark.createDataFrame([(i, 0, r.randint(1, 4096), i, 1) for i in range(20_000)], "id long, start long, length long, ids_crc32 long, doc_tokens long")
    rows = packing.pack_pieces(pieces).collect()
    assert len(rows) == 20_000
    windows = len({x.sequence_id for x in rows})
    assert sum(x.length for x in rows) / (windows * 4096) > 0.99


def test_best_fit_takes_the_tightest_window():
    r = random.Random(2)
    for _ in range(50):
        window = r.choice([7, 8, 64, 100])
        open_windows, plain = packing.OpenWindows(window), []
        for k in range(200):
            need = r.randint(1, window)
            got = open_windows.take(need)
            want = min((room for room, _ in plain if room >= need), default=None)
            assert (got and got[0]) == want
            if got:
                plain.remove(got)
            room = r.randint(1, window)
            open_windows.put(room, k)
            plain.append((room, k))


def test_repeated_and_missing_rows(spark):
    docs = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "no id"), (None, None)], "doc_id long, text string")
    rows = packing.pack_documents(docs, word_vocabulary()).collect()
    assert len(rows) == 4 and len({(r.sequence_id, r.offset) for r in rows}) == 4 and len({r.sequence_id for r in rows}) == 1
    assert packing.pack_documents(docs.limit(0), word_vocabulary()).count() == 0


def test_more_new_words_than_are_remembered(tokenizer):
    words = packing.WordTokenizer(word_vocabulary())
    words.remembered = 10
    for low in (0, 30, 15, 0):
        texts = [f"old word w{i}x{i}, {i * 7919}" for i in range(low, low + 40)]
        assert words.encode(texts) == [b"".join(x.to_bytes(4, "little") for x in tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_other_tokenizers_read_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.WordLevel({"a b": 3, "a": 4, "?": 5}, unk_token="?"))
    other.pre_tokenizer = pre_tokenizers.Split(",", "removed")
    other.save(str(tmp_path / "other.json"))
    read = packing.WordTokenizer(str(tmp_path / "other.json"))
    assert not read.by_words
    assert read.encode(["a b,a", "b", ""]) == [b"\3\0\0\0\4\0\0\0", b"\5\0\0\0", b""]


def test_ids_keep_their_width():
    import numpy as np
    import pyarrow as pa

    pieces = [np.array(x, "<u4").tobytes() for x in ([1, 65535], [65536], [2])]
    stored = [packing.narrow(x) for x in pieces]
    assert [len(x) for x in stored] == [4, 4, 2]
    assert packing.widened(pa.array(stored), np.array([2, 1, 1])).to_pylist() == [[1, 65535], [65536], [2]]


def test_words_equal_the_full_tokenizer(tokenizer):
    r = random.Random(5)
    words = packing.WordTokenizer(word_vocabulary())
    assert words.by_words
    parts = ["the", "Été", "naïve", "ß", "12", "—", "'s", "'T", ",", "***", "_", "`", "\u0301", "Σ", "x", "\u212a", "İ", "&&", "<|endoftext|>", "你", "ﬁ", "\xad", "\x0c", "\u2003"]
    texts = [" ".join("".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(30)) for _ in range(400)]
    assert words.encode(texts) == [b"".join(x.to_bytes(4, "little") for x in tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_squeezed_bytes_come_back():
    for data in (b"", b"a", b"ab", b"abc", bytes(range(256)) * 40):
        assert packing.unsqueezed(packing.squeezed(data)) == data
