import random
import zlib

from pyspark.sql import functions as F

from lectern.llm import learning, toxicity


def corpus(n, seed=1):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("ba", "do", "ki", "lu", "me", "ra", "su") for b in ("n", "r", "st", "vo")]
    docs, labels = [], []
    for i in range(n):
        sentences = [" ".join(r.choices(words, k=r.randint(3, 9))) for _ in range(r.randint(1, 12))]
        bad = r.random() < 0.3
        if bad:
            at = r.randrange(len(sentences))
            sentences[at] += " " + r.choice(["vile", "grimboso", "grimboli", "grimbona"])
        docs.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(bad)))
    return docs, labels


def test_held_out_accuracy_and_places(spark):
    docs, labels = corpus(900)
    docs += [(10_000, None), (10_001, ""), (None, "vile me"), (3, docs[3][1])]
    df = spark.createDataFrame([(*x, 1, "y") for x in docs], "doc_id long, text string, score int, lang string")
    got = toxicity.toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(docs)
    truth = dict(labels)
    held = [r for r in got if r.id in truth and zlib.crc32(str(r.id).encode()) % 5 == 0]
    right = sum((r.score >= 0.5) == bool(truth[r.id]) for r in held)
    assert len(held) > 100 and right / len(held) > 0.95
    for r in held:
        for x in r.offending or []:
            assert 0.5 <= x.score <= 1
            assert not truth[r.id] or x.sentence in dict(docs)[r.id]
    assert {r.score for r in got if r.id in (10_000, 10_001)} == {0.0}
    assert all(0 <= r.score <= 1 for r in got)


def test_held_out_fold_is_not_learned(spark):
    docs, labels = corpus(300)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    turned = known.withColumn("toxic", F.when(learning.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r.id: r.score for r in toxicity.toxicity(df, x).collect()} for x in (known, turned))
    assert a == b


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "a b. c"), (2, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = {r.id: r.score for r in toxicity.toxicity(df, none).collect()}
    assert got[2] == 0 and 0 < got[1] < 0.1
    assert toxicity.toxicity(df.limit(0), none).count() == 0
    one = spark.createDataFrame([(1, 1), (1, None), (2, 1), (None, 0)], "doc_id long, toxic int")
    assert toxicity.toxicity(df, one).count() == 2


def test_long_and_odd_texts():
    scorer = toxicity.Scorer([0.0] * toxicity.BUCKETS, -6.0)
    for text in ("x " * 300_000, "." * 10_000, "\n" * 1000, "é" * 10**6, "   "):
        assert 0 <= scorer.score(text)[0] <= 1


def test_query_like_a_plain_noisy_or(spark):
    """Every document's score from the fitted weights, sentence by sentence."""
    import math
    import re

    from lectern.llm.queries import op4_toxicity

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = learning.fit_in_task(learning.labelled_sample(docs, spark.read.parquet(f"{sf}/labels.parquet"), "toxic"), toxicity.fit)
    got = {r.doc_id: r for r in op4_toxicity(spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        clean = 1.0
        tokens = re.split("[ \t]", (r.text or "").replace("\n", " \n "))
        sentence = float(model["bias"][0])
        for i, x in enumerate(tokens if r.text else []):
            sentence += sum(float(model["weights"][b]) for b in toxicity.features(x) or [])
            if x == "\n" or x and x[-1] in toxicity.ENDS or i == len(tokens) - 1:
                clean *= 1 / (1 + math.exp(sentence))
                sentence = float(model["bias"][0])
        assert abs(got[r.doc_id].score - (1 - clean)) < 1e-5
        assert got[r.doc_id].predicted == (got[r.doc_id].score >= 0.5) and got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
