import datetime
import random

from pyspark.sql import functions as F

from lectern.operators import history as H

DAY = datetime.datetime(2024, 1, 1)


def test_eviction_to_size_like_a_running_sum(spark):
    r = random.Random(2)
    rows = [(i, DAY + datetime.timedelta(minutes=r.choice([0, 0, 1, 7]) + 1440 * r.choice([0, 0, 0, 3, 9])) if r.random() > 0.05 else None, r.choice([0, 5, 9, 100]), r.choice(["ready", "ready", "processing"])) for i in range(300)]
    entries = spark.createDataFrame(rows, "id long, created_at timestamp_ntz, bytes long, status string")
    total = sum(x[2] for x in rows)
    for target in (0, 1, 500, total // 2, total - 1, total, total + 5):
        left, gone = total, []
        for x in sorted((x for x in rows if x[3] != "processing"), key=lambda x: (x[1] or datetime.datetime.min, x[0])):
            if target and left > target:
                gone.append(x[0])
                left -= x[2]
        assert sorted(x.id for x in H.evict_to_size(entries, target).collect()) == sorted(gone), target
    assert H.evict_to_size(entries.limit(0), 5).count() == 0


def test_eviction_to_size_whatever_the_time_zone(spark):
    """Clocks skip 02:00 to 03:00 on 10 March 2024 in New York, and show 01:00 to 02:00 twice on 3 November."""
    minutes = [0, 90, 119, 120, 150, 179, 180, 190, None]
    plain = [(i, None if m is None else datetime.datetime(2024, 3, 10) + datetime.timedelta(minutes=m), 10, "ready") for i, m in enumerate(minutes * 3)]
    instants = [(i, 1730610000 + 600 * (i * 7 % 24), 10, "ready") for i in range(24)]  # from 05:00 UTC, 01:00 there, in steps of ten minutes
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        local = spark.createDataFrame(plain, "id long, created_at timestamp_ntz, bytes long, status string")
        exact = spark.createDataFrame(instants, "id long, s long, bytes long, status string").select("id", F.timestamp_seconds("s").alias("created_at"), "bytes", "status")
        for entries, rows, first in ((local, plain, datetime.datetime.min), (exact, instants, 0)):
            oldest = [x[0] for x in sorted(rows, key=lambda x: (x[1] or first, x[0]))]
            for kept in (1, 7, 13, 20):
                gone = H.evict_to_size(entries, 10 * kept).collect()
                assert sorted(x.id for x in gone) == sorted(oldest[: len(rows) - kept]), (entries.schema, kept)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def entries(spark):
    rows = [("a", "ready", "a.opus", None, "plain"), ("b", "ready", "b.wav", "b.json", "plain"), ("c", "processing", None, None, "html"), ("d", "ready", "gone.wav", None, None)]
    return spark.createDataFrame(rows, "id string, status string, audio_path string, timestamps_path string, format string")


def files(spark):
    return spark.createDataFrame([("a.opus",), ("b.wav",), ("b.json",)], "path string")


def test_changes(spark):
    e = entries(spark)
    kept, gone = H.delete_entries(e, spark.createDataFrame([("b",), ("b",), ("x",)], "id string"))
    assert sorted(r.id for r in kept.collect()) == ["a", "c", "d"] and sorted(r.path for r in gone.collect()) == ["b.json", "b.wav"]
    changed = H.set_format(e, spark.createDataFrame([("a", "html"), ("c", "pdf"), ("x", "html")], "id string, format string"))
    assert {r.id: r.format for r in changed.collect()} == {"a": "html", "b": "plain", "c": "html", "d": None}
    assert sorted(r.id for r in H.playable(e, files(spark)).collect()) == ["a", "b"]
    assert tuple(H.wav_migration(e, files(spark)).first()) == (1, 1, 1, 1)
    assert tuple(H.wav_migration(e.limit(0), files(spark)).first()) == (0, 0, 0, 0)
    repaired = {r.id: (r.status, r.audio_path) for r in H.repair_status(e.withColumn("duration_sec", F.lit(1.0)), files(spark)).collect()}
    assert repaired == {"a": ("ready", "a.opus"), "b": ("ready", "b.wav"), "c": ("pending", None), "d": ("pending", None)}


def test_events_put_and_remove(spark):
    e = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string")
    events = spark.createDataFrame([("a", None, 1, "removed"), ("a", "new", 2, "updated"), ("b", None, 3, "removed"), ("c", "z", 1, "updated"), ("d", "z", 1, "removed")], "id string, text string, seq int, kind string")
    assert sorted(tuple(r) for r in H.apply_events(e, events, "id", "seq").collect()) == [("a", "new"), ("c", "z")]
    assert sorted(tuple(r) for r in H.apply_events(e, events.limit(0), "id", "seq").collect()) == [("a", "x"), ("b", "y")]


def test_clearing(spark):
    now = F.lit("2024-01-01 00:10:00").cast("timestamp")
    listed = spark.createDataFrame([("old", DAY, 5), ("young", DAY + datetime.timedelta(minutes=9, seconds=30), 7), ("used", DAY, 9)], "name string, modified timestamp, length long")
    used = spark.createDataFrame([("used",), (None,)], "name string")
    rows = spark.createDataFrame([("a", DAY, 3 << 20, "ready"), ("b", DAY, 1 << 20, "processing"), ("c", DAY, None, "ready")], "id string, created_at timestamp_ntz, bytes long, status string")
    assert tuple(H.clear_cache(listed, used, rows, now).first()) == (1, 5, 1, 3 << 20)
    assert tuple(H.clear_cache(listed, used, rows, now, delete_texts=True).first()) == (1, 5, 2, 3 << 20)
    assert tuple(H.clear_cache(listed, used, rows, now, 2).first()) == (1, 5, 1, 3 << 20)
    assert tuple(H.startup_cleanup(listed, used, rows, now, 5 << 20).first()) == (1, 5, 0, 0)


def test_clearing_to_a_size_whatever_the_time_zone(spark):
    """02:30 of a day whose clocks skip from 02:00 to 03:00 is still before 03:10."""
    now = F.lit("2024-04-01 00:00:00").cast("timestamp")
    listed = spark.createDataFrame([], "name string, modified timestamp, length long")
    rows = spark.createDataFrame([(i, datetime.datetime(2024, 3, 10, h, m), n << 20, "ready") for i, h, m, n in (("a", 2, 30, 5), ("b", 3, 10, 7))], "id string, created_at timestamp_ntz, bytes long, status string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert tuple(H.startup_cleanup(listed, listed.select("name"), rows, now, 8 << 20).first()) == (0, 0, 1, 5 << 20)
        assert tuple(H.clear_cache(listed, listed.select("name"), rows, now, 8).first()) == (0, 0, 1, 5 << 20)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_ingest_search_and_order(spark):
    texts = spark.createDataFrame([("﻿Привет", "piper"), ("  ", "piper"), ("x" * 100_001, "piper"), ("x" * 100_001, "silero"), (None, "silero")], "text string, engine string")
    new, errors = H.ingest(texts, F.col("engine"))
    assert sorted(len(r.original_text) for r in new.collect()) == [6, 100_001] and sorted(r.message for r in errors.collect()) == ["empty text", "empty text", "text too long"]
    e = spark.createDataFrame([(i, f"Text {i}" if i % 2 else "other") for i in range(20)], "id int, original_text string")
    assert H.search(e, " TEXT 1 ").count() == 6 and H.search(e, "  ").count() == 20
    places = H.with_places(e.repartition(5).orderBy(F.desc("id"))).orderBy("place").collect()
    assert [(r.place, r.id) for r in places] == [(i + 1, 19 - i) for i in range(20)]
