import hashlib
import json
import struct

from pyspark.sql import functions as F

from lectern.sources import store


def _entry(i, status="ready"):
    return {"id": f"e{i}", "original_text": f"text {i}", "status": status, "created_at": f"2024-01-0{i}T00:00:00", "was_regenerated": False}


def test_history_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"version": 1, "entries": [_entry(1), _entry(2, "playing")]}, indent=1))
    (tmp_path / "b.json").write_text("{broken")
    entries = store.read_history(spark, str(tmp_path))
    assert sorted(r.id for r in entries.collect()) == ["e1", "e2"]
    assert [r.file.rsplit("/", 1)[-1] for r in store.corrupt_files(spark, str(tmp_path)).collect()] == ["b.json"]
    assert store.read_history(spark, str(tmp_path / "none")).count() == 0
    assert [r.original_text for r in store.entry(entries, "e2").collect()] == ["text 2"]
    assert store.entry(entries, "zz").count() == 0


def test_history_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"version": 1, "entries": [_entry(1, "playing"), _entry(2, "error")]}))
    entries = store.read_history(spark, str(tmp_path / "a.json"))
    store.write_history(entries, str(tmp_path / "out"))
    back = store.read_entries(spark, str(tmp_path / "out"))
    assert {r.id: r.status for r in back.collect()} == {"e1": "ready", "e2": "error"}
    assert back.columns == entries.columns
    assert store.read_entries(spark, str(tmp_path / "nowhere")).count() == 0


def test_word_times(spark, tmp_path):
    words = [{"word": "a", "start": 0.0, "end": 0.5, "original_pos": [0, 1]}, {"word": "b", "start": 0.5, "end": 1.0, "original_pos": [2, 3]}]
    (tmp_path / "x1.timestamps.json").write_text(json.dumps({"words": words}))
    (tmp_path / "other.json").write_text("{}")
    rows = store.read_word_times(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r.entry_id, r.idx, r.word, r.end, r.orig_start, r.orig_end) for r in rows] == [("x1", 0, "a", 0.5, 0, 1), ("x1", 1, "b", 1.0, 2, 3)]
    assert store.read_word_times(spark, str(tmp_path / "none")).count() == 0


def test_requests(spark):
    lines = ['{"cmd": "warmup", "id": 1}', '{"cmd": "synthesize", "id": 2, "text": "x"}', '{"cmd": "synthesize", "id": 3, "text": " "}', '{"cmd": "dance"}', "nonsense", None]
    rows = store.parse_requests(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, value string")).orderBy("i").collect()
    assert [r.error and r.error.message for r in rows] == [None, None, "empty text", "unknown command", "not a JSON object", "not a JSON object"]


def test_manifest(spark, tmp_path):
    good = b"12345"
    files = [{"path": "a", "size": 5, "sha256": hashlib.sha256(good).hexdigest()}, {"path": "b", "size": 9, "sha256": ""}, {"path": "c", "size": 5, "sha256": "0"}, {"path": "d", "size": 1, "sha256": ""}]
    (tmp_path / "m.json").write_text(json.dumps({"model_id": "m", "opset": 17, "files": files}))
    (tmp_path / "empty.json").write_text(json.dumps({"model_id": "n", "files": []}))
    manifest = store.read_manifest(spark, str(tmp_path))
    there = spark.createDataFrame([(x, bytearray(good)) for x in "abc"], "path string, content binary")
    found = store.verify(manifest, there)
    assert {r.path: r.problem for r in found.collect()} == {"a": None, "b": "size", "c": "checksum", "d": "missing"}
    assert [tuple(r) for r in store.first_problem(found).collect()] == [("m", "b", "size")]


def test_wav(spark, tmp_path):
    data = struct.pack("<3f", 0.0, 0.5, -1.0)
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 3, 1, 24000, 96000, 4, 32) + b"data" + struct.pack("<I", len(data))
    (tmp_path / "a.wav").write_bytes(b"RIFF" + struct.pack("<I", 0) + head + data)
    (tmp_path / "b.wav").write_bytes(b"RIFFxxxxWAVE")
    rows = {r.name: r for r in store.read_wav(spark, str(tmp_path)).collect()}
    assert rows["a.wav"].rate == 24000 and rows["a.wav"].samples == [0.0, 0.5, -1.0] and rows["b.wav"].samples is None
    clip = spark.createDataFrame([([0.0, 1.5, -0.5],)], "s array<double>").select(store.wav_bytes(F.col("s"), 8000).alias("w")).first().w
    assert struct.unpack("<3h", bytes(clip)[-6:]) == (0, 32767, -16384)


def test_file_listing(spark, tmp_path):
    (tmp_path / "x.opus").write_bytes(b"abc")
    assert [(r.name, r.length) for r in store.list_files(spark, str(tmp_path)).collect()] == [("x.opus", 3)]
    assert store.list_files(spark, str(tmp_path / "none")).count() == 0


def test_settings(spark, tmp_path):
    (tmp_path / "config.json").write_text('{"speaker": "baya", "sample_rate": "no number", "volume": 3}')
    row = store.read_settings(spark, str(tmp_path / "config.json")).first()
    assert (row.speaker, row.sample_rate, row.engine, row.window_geometry, row.player_hotkeys["next_entry"]) == ("baya", 24000, "silero_native", None, "n")
    fresh = store.read_settings(spark, str(tmp_path / "none.json"))
    assert fresh.first().speaker == "aidar"
    patch = spark.createDataFrame([('{"theme": "dark", "window_geometry": [1, 2, 3, 4], "other": 1}',)], "value string")
    row = store.patched_settings(fresh, patch).first()
    assert (row.theme, row.window_geometry, row.speaker) == ("dark", [1, 2, 3, 4], "aidar")


def test_dictionaries(spark, tmp_path):
    import gzip

    import pytest

    (tmp_path / "vocab.txt").write_text("[UNK]\n[CLS]\nслово\n", encoding="utf-8")
    assert sorted(tuple(r) for r in store.read_vocabulary(spark, str(tmp_path / "vocab.txt")).collect()) == [(0, "[UNK]"), (1, "[CLS]"), (2, "слово")]
    (tmp_path / "ngrams.gz").write_bytes(gzip.compress("<а а> \n<б ".encode()))
    assert sorted(tuple(r) for r in store.read_ngrams(spark, str(tmp_path / "ngrams.gz")).collect()) == [(0, "<а"), (1, "а>"), (2, "<б")]
    (tmp_path / "exceptions.gz").write_bytes(gzip.compress("елка 0 0\nдом 1 -1\n\n".encode()))
    assert sorted(tuple(r) for r in store.read_exceptions(spark, str(tmp_path / "exceptions.gz")).collect()) == [("дом", 1, -1), ("елка", 0, 0)]
    (tmp_path / "bad.gz").write_bytes(gzip.compress("дом x\n".encode()))
    with pytest.raises(Exception, match="malformed"):
        store.read_exceptions(spark, str(tmp_path / "bad.gz")).collect()


def test_lines_of_a_file_of_many_blocks(spark, tmp_path):
    tokens = [f"token {i} é" + "x" * (i % 40) for i in range(3000)]
    (tmp_path / "vocab.txt").write_text("\n".join(tokens) + "\n")
    (tmp_path / "grams.txt").write_text("\n".join(f" a{i}  b{i}" * (i % 3) for i in range(2000)))
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = [spark.conf.get(k, None) for k in keys]
    try:
        for k, v in zip(keys, ("3000", "1", "50")):
            spark.conf.set(k, v)
        assert store._lines(spark, str(tmp_path / "vocab.txt")).select("block").distinct().count() > 20
        assert sorted(tuple(r) for r in store.read_vocabulary(spark, str(tmp_path / "vocab.txt")).collect()) == list(enumerate(tokens))
        assert sorted(tuple(r) for r in store.read_ngrams(spark, str(tmp_path / "grams.txt")).collect()) == list(enumerate(g for i in range(2000) for g in [f"a{i}", f"b{i}"] * (i % 3)))
    finally:
        for k, v in zip(keys, before):
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_word_times_are_saved(spark, tmp_path):
    rows = [("a", 1, "два", 0.5, 1.0, 4, 7), ("a", 0, "раз", 0.0, 0.5, 0, 3), ("b", 0, "x", 0.0, 0.1, 0, 1)]
    df = spark.createDataFrame(rows, "entry_id string, idx int, word string, start double, end double, orig_start long, orig_end long")
    store.write_word_times(df, str(tmp_path / "times"))
    assert sorted(tuple(r) for r in store.read_saved_word_times(spark, str(tmp_path / "times")).collect()) == sorted(rows)


def test_word_times_of_one_entry_leave_the_others(spark, tmp_path):
    kind, path = "entry_id string, idx int, word string, start double, end double, orig_start long, orig_end long", str(tmp_path / "times")
    one, two, again = (spark.createDataFrame([(name, 0, word, 0.0, 0.5, 0, 3)], kind) for name, word in (("one", "раз"), ("two", "два"), ("one", "снова")))
    for df in (one, two, again):
        store.write_word_times(df, path)
    assert sorted((r.entry_id, r.word) for r in store.read_saved_word_times(spark, path).collect()) == [("one", "снова"), ("two", "два")]
    store.write_word_times(one.limit(0), path)
    assert store.read_saved_word_times(spark, path).count() == 2


def test_a_history_is_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "history")
    first = store.read_entries(spark, path)
    for name in ("a", "b"):
        store.write_history(spark.createDataFrame([(name, "x", "playing")], "id string, original_text string, status string"), path)
    (tmp_path / "history" / "entries-99999999999999999999").mkdir()  # cut short: no mark
    assert first.count() == 0 and [(r.id, r.status) for r in store.read_entries(spark, path).collect()] == [("b", "ready")]
    store.drop_former(spark, path)
    assert [r.id for r in store.read_entries(spark, path).collect()] == ["b"]


def test_later_versions_are_read_and_named(spark, tmp_path):
    (tmp_path / "h.json").write_text('{"version": 9, "entries": [{"id": "a"}]}')
    assert [r.version for r in store.newer_files(spark, str(tmp_path / "h.json")).collect()] == [9]
    assert store.read_history(spark, str(tmp_path / "h.json")).count() == 1
    assert store.newer_files(spark, str(tmp_path / "none")).count() == 0
