from lectern.llm import learning


def sample(spark, docs, labels, **more):
    df = spark.createDataFrame([(*x, 1, "y") for x in docs], "doc_id long, text string, label int, weight string")
    return learning.labelled_sample(df, spark.createDataFrame(labels, "doc_id long, toxic int"), "toxic", **more).collect()


def test_bounds_in_rows_and_bytes(spark, monkeypatch):
    docs = [(i % 40, f"text {i}") for i in range(4000)] + [(41, "x" * 200), (None, "no id"), (1, None)]
    labels = [(i, i % 2) for i in range(60)] + [(None, 1), (3, None), (2, 1)]
    rows = sample(spark, docs, labels, per_class=100)
    assert len(rows) == 300 and len({r.text for r in rows}) == 300
    monkeypatch.setattr(learning, "TEXT_BYTES", 100)
    rows = sample(spark, docs, labels)
    assert len(rows) > 2000 and not [r for r in rows if len(r.text) > 100]
    assert {r.label for r in rows if int(r.text.split()[1]) % 40 == 2} == ({1} if rows and not learning_holds_out(spark, 2) else set())


def learning_holds_out(spark, doc_id):
    from pyspark.sql import functions as F

    return spark.range(1).select(learning.held_out(F.lit(doc_id))).first()[0]


def test_nothing_to_learn(spark):
    assert sample(spark, [(1, "a")], []) == []
    assert sample(spark, [], [(1, 1)]) == []
    held = [i for i in range(30) if learning_holds_out(spark, i)]
    assert held and sample(spark, [(i, "a") for i in held], [(i, 1) for i in held]) == []
