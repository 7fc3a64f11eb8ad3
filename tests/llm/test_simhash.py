import itertools
import random

import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

from lectern.llm import simhash
from lectern.session import settle


def brute(rows, n=3, radius=2):
    prints = []
    for _, text in rows:
        words = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for c in "\t\n\x0b\x0c\r":
            words = words.replace(c, " ")
        words = [w for w in words.split(" ") if w]
        grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[top(i)] = min(k, least.get(top(i), k))
    return sorted(((k, prints[i], least.get(top(i))) for i, (k, _) in enumerate(rows)), key=repr)


def run(spark, rows, **extra):
    docs = spark.createDataFrame([Row(doc_id=k, text=t, fingerprint="x", key="y") for k, t in rows], "doc_id long, text string, fingerprint string, key string")
    return sorted(((r.id, r.fingerprint % 2**64, r.component_id) for r in simhash.simhash_components(docs, **extra).collect()), key=repr)


def test_masks_cover_every_close_pair():
    for radius in (1, 2, 3):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for bits in itertools.combinations(range(0, 64, 3), radius):
            assert any(not any(m >> b & 1 for b in bits) for m in masks)


def test_like_brute_force(spark):
    r = random.Random(4)
    vocabulary = ["Äpfel", "the", "of", "Nana", "İx", "gamma", "tree", "stone", "river"]
    rows = [(i, " ".join(r.choices(vocabulary, k=r.randint(0, 12)))) for i in range(120)]
    long = [f"w{r.randint(0, 10**6)}" for _ in range(900)]
    for i in range(40):
        edited = list(long)
        for _ in range(r.randint(0, 6)):
            edited[r.randrange(900)] = "edit"
        rows.append((1000 + i, " ".join(edited)))
    rows += [(5000, None), (5001, ""), (5002, " \t\r\n"), (7, rows[3][1]), (7, rows[3][1]), (None, "lonely words here"), (5003, "one"), (5004, "ONE")]
    assert run(spark, rows) == brute(rows)


def test_one_large_group_of_near_fingerprints(spark):
    docs = spark.range(1).selectExpr("0L AS fingerprint").union(spark.range(63).selectExpr("shiftleft(1L, CAST(id AS INT))"))
    edges = [(r.u, r.v) for r in simhash.covering_links(docs).collect()]
    assert {x for e in edges for x in e} == {0, *(1 << i for i in range(63))}
    assert all((u ^ v).bit_count() <= 2 for u, v in edges)


def test_empty(spark):
    assert run(spark, []) == []


def similarity(a, b, n=5):
    x, y = ({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if (w := (t or "").lower().split()) else set() for t in (a, b))
    return len(x & y) / max(1, len(x | y))


def copies(seed=3, hub_copies=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(2, 7)))
    rows = [(i, " ".join(word() for _ in range(r.randint(20, 300)))) for i in range(150)]
    for i in range(60):
        w = rows[r.randrange(150)][1].split()
        for _ in range(r.randint(0, max(1, len(w) // 60))):
            w[r.randrange(len(w))] = word()
        rows.append((1000 + i, " ".join(w)))
    hub = [word() for _ in range(200)]
    rows.append((5, " ".join(hub)))
    for i in range(hub_copies):
        w = list(hub)
        for _ in range(3):
            w[r.randrange(200)] = word()
        rows.append((2000 + i, " ".join(w)))
    return rows + [(3000, None), (3001, ""), (3002, rows[0][1]), (0, rows[0][1]), (None, rows[1][1]), (None, "alone"), (3003, "one two"), (3004, "ONE  two\n")]


def test_near_duplicates_like_brute_force(spark):
    rows = copies()
    docs = spark.createDataFrame([(*x, 1, "g") for x in rows], "doc_id long, text string, node int, group string")
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if similarity(rows[i][1], rows[j][1]) >= 0.8 or (rows[i][1] or "") == (rows[j][1] or ""):
            root[max(top(i), top(j))] = min(top(i), top(j))
    sizes = len({top(i) for i in range(len(rows))})
    kept = simhash.first_of_groups(docs)
    assert kept.columns == docs.columns
    kept = kept.collect()
    assert len(kept) == sizes
    assert {(r.doc_id, r.text) for r in kept} <= set(rows)
    assert sum(r.doc_id is not None and 2000 <= r.doc_id < 3000 for r in kept) <= 1
    assert len([r for r in kept if r.doc_id == 5]) >= 1
    groups = simhash.near_duplicates(docs).collect()
    assert len(groups) == len(rows)
    for a, b in itertools.combinations([(r.id, r.group) for r in groups if r.id is not None and r.id < 150], 2):
        if a[1] == b[1] and a[0] != b[0]:
            x, y = ([t for k, t in rows if k == q[0]] for q in (a, b))
            assert any(similarity(s, t) > 0.5 for s in x for t in y)


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.first_of_groups(docs).count() == 0 and simhash.near_duplicates(docs).count() == 0


def groups_by_brute_force(rows):
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for _, t in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) > 0 or (rows[i][1] or "") == (rows[j][1] or ""):
            root[max(top(i), top(j))] = min(top(i), top(j))
    found = {}
    for i, (k, _) in enumerate(rows):
        found.setdefault(top(i), set()).add(k)
    return sorted(map(sorted, found.values()))


def groups(spark, rows):
    found = {}
    for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found.setdefault(r.group, set()).add(r.id)
    return sorted(map(sorted, found.values()))


def invented(r, n):
    return ["".join(r.choices("abcdefghij", k=r.randint(3, 8))) for _ in range(n)]


def test_block_edits_like_brute_force(spark):
    """Copies with a block more, less or replaced, at similarities about 0.8 to 0.9."""
    r, rows = random.Random(11), []
    for i in range(60):
        w = invented(r, r.randint(60, 400))
        n = len(w)
        part = lambda x: int(n * x)
        rows.append((10 * i, " ".join(w)))
        rows.append((10 * i + 1, " ".join(w + invented(r, part(r.uniform(0.11, 0.26))))))
        rows.append((10 * i + 2, " ".join(w[: part(r.uniform(0.78, 0.9))])))
        at = r.randint(0, n // 2)
        rows.append((10 * i + 3, " ".join(w[:at] + invented(r, k := part(r.uniform(0.05, 0.12))) + w[at + k :])))
    expected = groups_by_brute_force(rows)
    assert 60 < len(expected) < 240
    assert groups(spark, rows) == expected


def test_variants_without_their_template(spark):
    """Large buckets without a text that is near the others: few pairs link, and each of them counts."""
    r, rows = random.Random(12), []
    for words, edits, count in ((300, 5, 250), (300, 4, 60)):
        template = invented(r, words)
        for _ in range(count):
            w = list(template)
            for k in r.sample(range(words), edits):
                w[k] = invented(r, 1)[0]
            rows.append((len(rows), " ".join(w)))
    expected = groups_by_brute_force(rows)
    assert any(len(x) > 1 for x in expected) and len(expected) > 100
    assert groups(spark, rows) == expected


def test_texts_of_few_words_with_a_tail_of_new_ones(spark):
    """Sets of words that differ much more than those of shingles."""
    r, rows = random.Random(13), []
    for i in range(8):
        few = invented(r, 100)
        w = r.choices(few, k=2000)
        rows += [(10 * i, " ".join(w)), (10 * i + 1, " ".join(w + invented(r, 400))), (10 * i + 2, " ".join(w + invented(r, 700)))]
    expected = groups_by_brute_force(rows)
    assert sorted(map(len, expected)) == [1] * 8 + [2] * 8
    assert groups(spark, rows) == expected


def test_prefixes_of_similar_sets_meet():
    import numpy as np

    r = random.Random(14)
    for _ in range(300):
        n = r.randint(1, 60)
        base = r.sample(range(1000), n + 20)
        a, b = (np.array(sorted(x), np.uint64) for x in (base[:n], base[r.randint(0, n // 8) : n + r.randint(0, n // 8)]))
        common = np.array(sorted(r.sample(range(1000), 200)), np.uint64)
        counts = np.array(r.choices(range(3, 9), k=200))
        if simhash.jaccard(a, b) >= 0.8:
            assert set(simhash.prefix(a, 0.8, common, counts)) & set(simhash.prefix(b, 0.8, common, counts))


def test_parities_differ_no_more_than_their_sets():
    import numpy as np

    r = random.Random(15)
    sets = [np.array(sorted(r.sample(range(1 << 40), r.choice([0, 1, 5, 31, 32, 33, 40, 300]))), np.uint64) for _ in range(40)]
    sets += [np.array(sorted(r.sample(x.tolist(), len(x) * 9 // 10)), np.uint64) for x in sets]
    n = np.array(list(map(len, sets)))
    found = simhash.Parities(n, list(map(simhash.parity, sets)))
    for i in range(len(sets)):
        apart = np.array([len(np.setxor1d(sets[i], x)) for x in sets])
        least = found.apart(i, np.arange(len(sets))) * np.maximum(1, n + n[i])
        assert (least <= apart + 1e-6).all() and (least >= np.abs(n - n[i]) - 1e-6).all()
        near = apart <= n[i] // 8
        assert (least[near] >= apart[near] * 0.6).all()


def test_large_buckets_are_cut_into_blocks(spark, monkeypatch):
    """The same groups when a bucket is many blocks: one large group, few others, and many variants that don't link."""
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", 7)
    monkeypatch.setattr(simhash, "CHUNK", 5)
    r, rows = random.Random(16), []
    for words, edits, count in ((300, 1, 60), (300, 5, 60), (120, 2, 40)):
        template = invented(r, words)
        for _ in range(count):
            w = list(template)
            for k in r.sample(range(words), edits):
                w[k] = invented(r, 1)[0]
            rows.append((len(rows), " ".join(w)))
    expected = groups_by_brute_force(rows)
    assert max(map(len, expected)) >= 60 and len(expected) > 20
    assert groups(spark, rows) == expected


def test_one_row_of_every_group_stays(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BROADCAST_KEYS", 3)
    text = " ".join(map(str, range(50)))
    rows = [(4, text, "x"), (2, text + " a", "y"), (2, text + " a", "z"), (2, text + " a", None), (None, text, "n"), (None, None, "p"), (7, "", "q"), (8, "alone", None), (None, "alone too", "g"), (None, "alone too", "h")]
    kept = simhash.first_of_groups(spark.createDataFrame(rows, "doc_id long, text string, kept string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id is not None) == [(2, text + " a"), (7, ""), (8, "alone")]
    assert [r.text for r in kept if r.doc_id is None] == ["alone too"]


def test_a_template_of_many_variants_that_are_not_similar(spark):
    """4000 texts of one template, 100 of whose 132 shingles are common to each two, are one bucket in which nobody meets; three similar ones do."""
    r = random.Random(21)
    template, rows = invented(r, 120), []
    for i in range(4_000):
        w = list(template)
        w[80:92] = [f"x{i}a{k}" for k in range(12)]
        rows.append((i, " ".join(w)))
    near = template[:60] + ["near"] + template[61:]
    rows += [(50_000, " ".join(near)), (50_001, " ".join(near + ["more"])), (50_002, " ".join(near + ["less"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    classes = settle(simhash._classes(docs, "doc_id", "text", 0.8).withColumn("node", F.monotonically_increasing_id()))
    alone = simhash._members(classes).withColumn("root", F.col("node"))
    found = settle(simhash._pairs_of_roots(alone, 0.8))
    ids = {row.node: row.least_id for row in classes.select("node", "least_id").collect()}
    pairs = {tuple(sorted((ids[x.a], ids[x.b]))) for x in found.collect()}
    assert {(50_000, 50_001), (50_000, 50_002), (50_001, 50_002)} <= pairs and len(pairs) <= 2 * len(rows) + 1


def test_fingerprints_link_before_the_exact_join(spark, monkeypatch):
    r = random.Random(8)
    long = invented(r, 3000)
    edited = [*long[:-1], "edit"]
    # one shingle makes most of these two, so their fingerprints agree; their sets don't
    alike = [" ".join(["same"] * 300 + invented(r, 40)) for _ in range(2)]
    rows = [(0, " ".join(long)), (1, " ".join(edited)), (2, alike[0]), (3, alike[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {x.id: x.fingerprint % 2**64 for x in simhash.fingerprints(docs, shingle=simhash.SHINGLE).collect()}
    assert (prints[0] ^ prints[1]).bit_count() <= simhash.RADIUS and prints[2] == prints[3]
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(simhash, "_forest_pairs", lambda *_: none)
    monkeypatch.setattr(simhash, "_pairs_of_roots", lambda *_: none)
    assert groups(spark, rows) == [[0, 1], [2], [3]]
