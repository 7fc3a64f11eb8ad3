import random
import re

from lectern.llm import decontamination as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, window=13):
    out = []
    for k, text in docs:
        words, hit, names = split(text), set(), set()
        for name, item in items:
            own = split(item)
            if name is None or not own:
                continue
            n = min(window, len(own))
            grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    names.add(str(name))
        out.append((k, len(words), len(hit), sorted(names)))
    return sorted(out, key=repr)


def run(spark, docs, items, **extra):
    docs = spark.createDataFrame([(k, t, "x", [1]) for k, t in docs], "doc_id long, text string, words string, fingerprint array<int>")
    items = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, length int")
    return sorted(((r.id, r.n_words, r.n_hit, r["items"]) for r in D.contamination(docs, items, **extra).collect()), key=repr)


def test_like_brute_force(spark):
    r = random.Random(7)
    vocabulary = ["É", "é", "a", "B1", "naïve", "the", "x9", "Über"]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([1, 3, 4, 5, 7, 12, 13, 20, 40])))) for i in range(25)]
    items += [(3, items[5][1]), (None, "a the"), (90, None), (91, "..."), (92, items[0][1]), (10**12, items[1][1])]
    docs = [(i, ", ".join(r.choices(vocabulary, k=r.randint(0, 60)))) for i in range(60)]
    for i in range(30):
        words = [f"w{r.randint(0, 9999)}" for _ in range(200)]
        at = r.randrange(200)
        words[at:at] = split(r.choice(items)[1])
        docs.append((100 + i, " ".join(words)))
    docs += [(7, None), (7, ""), (7, "!!!"), (None, items[3][1]), (5, docs[80][1]), (5, docs[80][1])]
    assert run(spark, docs, items) == brute(docs, items)


def test_shuffled_when_the_benchmark_is_large(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    items = [(1, " ".join(f"w{i}" for i in range(30))), (2, "short one")]
    docs = [(1, "x " + items[0][1].upper() + " y"), (2, "short ONE"), (3, "none")]
    assert run(spark, docs, items) == brute(docs, items)


def test_long_documents_are_shuffled_without_their_words(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_ROWS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        r = random.Random(9)
        words = [f"w{r.randint(0, 10**7)}" for _ in range(200_000)]
        items = [(i, " ".join(words[i * 3000 : i * 3000 + 40])) for i in range(50)]
        docs = [(1, " ".join(words)), (2, " ".join(words)), (3, "nothing of it"), (4, items[7][1])]
        assert run(spark, docs, items) == brute(docs, items)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_empty(spark):
    assert run(spark, [], [(1, "a")]) == []
    assert run(spark, [(1, "A b")], []) == [(1, 2, 0, [])]
