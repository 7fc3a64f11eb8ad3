import random
import zlib

import numpy as np

from lectern.llm import quality


def corpus(n, seed=2):
    """Grade 0: shouting and signs; 1: a few of them; 2: plain words."""
    r = random.Random(seed)
    words = [a + b + c for a in ("ba", "do", "ki", "lu") for b in ("n", "r", "st") for c in ("a", "em", "is", "o")]
    docs, grades = [], []
    for i in range(n):
        grade = r.choice([0, 1, 2, 2])
        share = {0: 0.8, 1: 0.25, 2: 0.0}[grade]
        docs.append((i, " ".join(w.upper() + "!!" if r.random() < share else w for w in r.choices(words, k=r.randint(20, 80)))))
        grades.append((i, grade))
    return docs, grades


def frames(spark, docs, grades):
    return spark.createDataFrame([(*x, 0.5, "z") for x in docs], "doc_id long, text string, expected_grade double, keep string"), spark.createDataFrame(grades, "doc_id long, quality int")


def test_held_out_accuracy_for_three_grades(spark):
    docs, grades = corpus(800)
    docs += [(5000, None), (5001, ""), (None, "plain"), (7, docs[7][1])]
    got = quality.quality(*frames(spark, docs, grades)).collect()
    assert len(got) == len(docs)
    truth = dict(grades)
    held = [r for r in got if r.id in truth and zlib.crc32(str(r.id).encode()) % 5 == 0]
    assert len(held) > 100 and np.mean([round(r.expected_grade) == truth[r.id] for r in held]) > 0.9
    assert np.mean([r.keep == (truth[r.id] == 2) for r in held]) > 0.95
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.chance <= 1 for r in got)


def test_thresholds_are_ordered():
    docs, grades = corpus(200)
    model = quality.fit([x for _, x in docs], np.array([g for _, g in grades]), np.ones(200))
    assert list(model["levels"]) == [0, 1, 2] and model["thresholds"][0] < model["thresholds"][1]
    tail = quality.Grader(**model).grade("anything AT!! all")[1]
    assert tail[0] >= tail[1]


def test_gradient_is_the_slope_of_the_likelihood(monkeypatch):
    docs, grades = corpus(40)
    texts, g, w = [x for _, x in docs], np.array([x for _, x in grades]), np.ones(40) / 40
    seen = {}
    monkeypatch.setattr(quality, "SHRINK", 0.0)
    monkeypatch.setattr(quality, "adam", lambda start, gradient, steps, rate: seen.update(f=gradient) or start)
    quality.fit(texts, g, w)
    tokens = quality.Tokens()
    rows = [tokens.features(x) for x in texts]

    def loss(x):
        cuts = np.cumsum([x[-2], np.exp(x[-1])])
        total = 0.0
        for (b, v), y, a in zip(rows, g, w):
            p = [1, *(1 / (1 + np.exp(-((x[b] * v).sum() - cuts)))), 0]
            total -= a * np.log(p[y] - p[y + 1])
        return total

    x = np.random.default_rng(0).normal(0, 0.3, quality.BUCKETS + quality.LAGS + 1 + 2)
    slope = seen["f"](x)
    for i in (int(rows[0][0][0]), quality.BUCKETS + 1, len(x) - 2, len(x) - 1):
        step = np.zeros_like(x)
        step[i] = 1e-5
        assert abs((loss(x + step) - loss(x - step)) / 2e-5 - slope[i]) < 1e-6


def test_without_ratings(spark):
    docs, none = frames(spark, [(1, "a"), (2, None)], [])
    assert [r.keep for r in quality.quality(docs, none).collect()] == [True, True]
    assert quality.quality(docs.limit(0), none).count() == 0
    docs, one = frames(spark, [(1, "a"), (2, "b")], [(1, 1), (2, 1), (2, None)])
    assert [r.keep for r in quality.quality(docs, one).collect()] == [True, True]


def test_odd_texts():
    grader = quality.Grader(np.zeros(quality.BUCKETS + quality.LAGS + 1), np.array([0.0]), np.array([0, 1]))
    for text in ("x" * 10**6, "x " * 200_000, "　 \n", "😀" * 1000):
        assert grader.grade(text)[1] == [0.5]


def test_all_of_a_text_without_white_space_is_read():
    tokens = quality.Tokens()
    plain, spoilt = tokens.features("ab" * 500), tokens.features("ab" * 400 + "A!?9" * 50)
    rare = set(spoilt[0].tolist()) - set(plain[0].tolist())
    assert len(rare) >= 3
    assert "".join(quality.pieces("x" * 1001 + " y\n" + "z" * 200)) == "x" * 1001 + "y" + "z" * 200
    model = quality.fit(["ab" * 500, "ab" * 400 + "A!?9" * 50] * 20, np.array([1, 0] * 20), np.ones(40))
    good, bad = (quality.Grader(**model).grade("ab" * 100 + "cd" * 400 + end)[0] for end in ("ef" * 100, "A!?9" * 50))
    assert good > bad + 0.2


def plain_features(text):
    """Shares of shapes, pairs of shapes, words and repeats, by the docstring."""
    from collections import Counter

    from xxhash import xxh32_intdigest

    tokens = [w[k : k + 200] for w in (text or "").split() for k in range(0, len(w), 200)]
    shapes = [xxh32_intdigest("s" + quality.shape(x)) for x in tokens]
    found = Counter(s % quality.BUCKETS for s in shapes)
    found.update((a * 31 + b + 7) % quality.BUCKETS for a, b in zip(shapes, shapes[1:]))
    found.update(xxh32_intdigest("w" + x.lower()) % quality.BUCKETS for x in tokens)
    for lag in range(1, quality.LAGS + 1):
        found[quality.BUCKETS + lag - 1] = sum(a == b for a, b in zip(tokens, tokens[lag:]))
    found[quality.BUCKETS + quality.LAGS] = len(tokens) - len(set(tokens))
    return {k: v / len(tokens) for k, v in found.items()} if tokens else {}


def test_query_like_a_plain_model(spark):
    """Every document's grade from the fitted weights by a dictionary and the formula of the model."""
    import math

    from lectern.llm.queries import op9_quality

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r.doc_id: r for r in op9_quality(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(texts)
    for k, text in texts.items():
        score = sum(model["weights"][b] * v for b, v in plain_features(text).items())
        tail = [1 / (1 + math.exp(-(score - c))) for c in model["thresholds"]]
        assert abs(got[k].chance - tail[-1]) < 1e-5 and got[k].keep == (got[k].chance >= 0.5)
        assert abs(got[k].expected_grade - (model["levels"][0] + sum(tail))) < 1e-5
