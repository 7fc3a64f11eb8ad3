"""Stored tables: parts that are deleted by themselves, and shuffles that go with their write."""

from pathlib import Path

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern import session
from lectern.functions.numbers import int_words
from lectern.session import BYTES_MOST, CLEAN_KEY, _SETTLED, forget, settle, settle_parts


def test_parts_are_tables_of_their_own(spark):
    rows = spark.range(10).select("id", F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("kind"))
    a, b, none = settle_parts(rows, "kind", ["a", "b", "c"])
    assert sorted(r.id for r in a.collect()) == [0, 3, 6, 9] and b.count() == 6 and none.count() == 0 and a.columns == ["id"]
    folder = Path(_SETTLED[a])
    forget(a)
    assert not folder.exists() and b.count() == 6


@pytest.mark.parametrize("before", [None, "false"])
def test_the_setting_of_the_session_stays(spark, before):
    was = spark.conf.get(CLEAN_KEY, None)
    try:
        spark.conf.unset(CLEAN_KEY) if before is None else spark.conf.set(CLEAN_KEY, before)
        found = spark.conf.get(CLEAN_KEY, None)
        assert settle(spark.range(5).repartition(2, "id")).count() == 5 and spark.conf.get(CLEAN_KEY, None) == found
    finally:
        spark.conf.unset(CLEAN_KEY) if was is None else spark.conf.set(CLEAN_KEY, was)


def test_batches_of_long_texts_are_of_few_rows(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"])

    texts = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
    got = texts.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in got) == 400 and max(r.bytes for r in got) < 2 * BYTES_MOST
    lengths = texts.select(F.pandas_udf(lambda x: pd.Series([len(x)] * len(x)), "long")("text").alias("n")).collect()
    assert max(r.n for r in lengths) * 100_000 < 2 * BYTES_MOST


def test_tables_of_words_do_not_fill_the_driver_with_descriptions(spark, monkeypatch):
    key, was = "spark.sql.maxPlanStringLength", spark.conf.get("spark.sql.maxPlanStringLength")
    try:
        spark.conf.set(key, "2147483632")  # Spark's own
        monkeypatch.setattr(session, "_asked", lambda spark: {})
        session.ready(spark)
        assert len(spark.range(3).select(int_words(F.col("id")))._jdf.queryExecution().toString()) < 500_000
        spark.conf.set(key, "7000")
        monkeypatch.setattr(session, "_asked", lambda spark: {key: "7000"})
        assert session.ready(spark).conf.get(key) == "7000"
    finally:
        spark.conf.set(key, was)
