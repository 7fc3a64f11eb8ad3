"""Clips joined in segments, against plain lists."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lectern.operators import samples as A


def test_clips_are_joined_in_segments(spark):
    r = random.Random(2)
    clips = [(k, i, [float(r.randint(0, 9)) for _ in range(r.choice([0, 1, 7, 40]))]) for k in ("a", "b") for i in range(30)] + [("a", 31, None), ("c", 0, [0.5] * 95), ("d", 0, []), (None, 1, [1.0])]
    df = spark.createDataFrame(r.sample(clips, len(clips)), "entry string, idx int, clip array<double>").selectExpr("*", "1 AS row", "2 AS segment")
    for size in (1, 10, 1000):
        got = {}
        for x in A.join_clips(df, "entry", "idx", "clip", size).orderBy("segment").collect():
            assert x.start == x.segment * size and (len(x.samples) == size or x.segment == (len(got.get(x.entry, [])) // size))
            got[x.entry] = got.get(x.entry, []) + x.samples
        want = {}
        for k, _, clip in sorted(clips, key=lambda x: (str(x[0]), x[1])):
            want[k] = want.get(k, []) + (clip or [])
        assert got == {k: v for k, v in want.items() if v}
    assert {x.entry: (x.n_samples, x.seconds) for x in A.durations(df, "entry", "clip", 10).collect()} == {k: (len(v), len(v) / 10) for k, v in want.items()}
    assert A.join_clips(df.limit(0), "entry", "idx", "clip", 5).count() == 0


def test_rounded_samples_keep_their_sign(spark):
    values = [-3e-7, 3e-7, -0.0, 0.0, -1.2345674, 1.2345676, None, float("nan")]
    got = spark.createDataFrame([(values,), ([],), (None,)], "x array<double>").select(A.rounded(F.col("x"), 6).alias("y")).collect()
    assert [repr(x) for x in got[0].y] == ["-0.0", "0.0", "-0.0", "0.0", "-1.234567", "1.234568", "None", "nan"]
    assert [r.y for r in got[1:]] == [[], None]


def test_resampled_zeros_like_sql(spark, tmp_path):
    rows = [(1, [-0.0000003, 0.0000001, -0.0000001, 0.25]), (2, [-0.0, 0.0, -0.5])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    like_sql(spark, "resample", tmp_path)


def test_lowest_band_zeros_like_sql(spark, tmp_path):
    rows = [(1, [-1e-7, 1e-7, -2e-7, 1e-7] * 16), (2, [0.25, -0.5] * 32), (3, [1e-6, 2e-6, -3e-6] * 20)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    like_sql(spark, "lowest_band", tmp_path)


def like_sql(spark, name, folder):
    db = pytest.importorskip("duckdb").connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    want = {k: list(map(repr, v)) for k, v in db.execute(entry.oracle_sql()[name]).fetchall()}
    assert {r.vec_id: list(map(repr, r.samples)) for r in entry.queries()[name](spark, str(folder)).collect()} == want
    assert any("-0.0" in v for v in want.values())
