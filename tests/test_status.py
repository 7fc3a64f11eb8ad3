import random

from pyspark.sql import functions as F

from lectern.streaming import status as S

KINDS = ["start", "complete", "fail", "cancel", "regenerate", "unknown"]


def plain(kinds):
    s = a = d = 0
    for k in kinds:
        after = S.TRANSITIONS.get(k, (None,) * 4)[s]
        s, a, d = (s, a, d + 1) if after is None else (after, a + 1, d)
    return S.STATES[s], a, d


def events(n=400, seed=5):
    r = random.Random(seed)
    return [(r.choice(["a", "a", "b", "c", None]), i, r.choice(KINDS)) for i in range(n)]


def expected(rows):
    by_key = {}
    for k, _, kind in sorted(rows, key=lambda x: x[1]):
        by_key.setdefault(k, []).append(kind)
    return {k: plain(v) for k, v in by_key.items()}


def test_chunks_are_composed(spark):
    rows = events()
    df = spark.createDataFrame(rows, "id string, seq long, what string")
    found = S.fold_statuses(df.repartition(7), "id", "what", ["seq"], F.floor(F.col("seq") / 30))
    assert {r.id: (r.status, r.accepted, r.discarded) for r in found.collect()} == expected(rows)
    assert S.fold_statuses(df.limit(0), "id", "what", ["seq"], F.floor(F.col("seq") / 30)).count() == 0


def stream(spark, tmp_path, parts, schema, query, mode):
    """The last batch's rows of each run of a stream that gets its files one after the other."""
    out, folder = [], tmp_path / "in"
    folder.mkdir()
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
        source = spark.readStream.schema(schema).parquet(str(folder))
        run = query(source).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        run.awaitTermination(120)
    return out


def test_statuses_of_a_stream(spark, tmp_path):
    rows = [x for x in events(90) if x[0]]
    seen = stream(spark, tmp_path, [rows[:40], rows[40:]], "id string, seq long, what string", lambda df: S.stream_statuses(df, "id", "what", ["seq"]), "update")
    assert {r.id: (r.status, r.accepted, r.discarded) for r in seen} == expected(rows)


def test_positions_of_a_stream(spark, tmp_path):
    a = [("e", 0, "tick", 1.0, 10.0), ("e", 100, "seek", 5.0, 10.0), ("e", 200, "tick", 1.1, 10.0), ("e", 399, "tick", 5.2, 10.0), ("e", 400, "tick", 5.3, 10.0)]
    b = [("e", 500, "tick", None, None), ("e", 600, "tick", 9.8, 10.0), ("e", 700, "tick", 9.9, 10.0), ("f", 0, "tick", 3.0, 0.0)]
    seen = stream(spark, tmp_path, [a, b], "entry_id string, ts_ms long, kind string, position double, duration double", S.position_events, "append")
    told = sorted((r.entry_id, r.ts_ms, r.event, r.position) for r in seen)
    assert told == [("e", 0, "position", 1.0), ("e", 100, "position", 5.0), ("e", 400, "position", 5.3), ("e", 600, "finished", 9.8), ("f", 0, "position", 3.0)]


def test_queue_of_a_stream(spark, tmp_path):
    a = [("e", 1, "updated", "ready"), ("e", 2, "started", None), ("f", 3, "updated", "pending"), ("f", 4, "removed", None)]
    b = [("e", 5, "finished", None), ("f", 6, "started", None)]
    seen = stream(spark, tmp_path, [a, b], "id string, seq long, kind string, status string", S.queue_events, "update")
    rows = [(r.id, r.status, r.playing, r.removed) for r in seen]
    assert sorted(rows[:2]) == [("e", "ready", True, False), ("f", "pending", False, True)] and sorted(rows[2:]) == [("e", "ready", False, False), ("f", "pending", False, True)]


def test_highlight_of_a_stream(spark, tmp_path):
    words = spark.createDataFrame([("e", 0, "one", 0.0, 0.0, 1.0), ("e", 1, "two", 1.5, 1.0, 2.0)], "entry_id string, idx int, word string, start double, previous_end double, end double")
    seen = stream(spark, tmp_path, [[("e", 0.5), ("e", 1.2), ("e", 2.0), ("x", 0.1)]], "entry_id string, position_sec double", lambda df: S.highlight_stream(df, words), "append")
    assert sorted((r.position_sec, r.word) for r in seen) == [(0.5, "one"), (1.2, "two")]


def test_ends_and_silence(spark):
    rows = [(None, None, False), (None, 5.0, True), (4.9, 5.0, True), (1.0, 5.0, False), (0.0, 0.0, False)]
    df = spark.createDataFrame([x[:2] for x in rows], "p double, d double").coalesce(1)
    assert [r[0] for r in df.select(S.at_end(F.col("p"), F.col("d"))).collect()] == [x[2] for x in rows]
