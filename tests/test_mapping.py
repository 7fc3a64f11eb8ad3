import random

from pyspark.sql import functions as F

from lectern.operators import mapping as M
from lectern.plans import table_queries


def test_ranges_words_and_spans_like_brute_force(spark):
    r = random.Random(1)
    spans = [(d, s, s + r.randint(1, 90), 2 * s, 2 * s + r.randint(1, 30)) for d in (1, 2) for s in r.sample(range(600), 60)] + [(None, 0, 5, 0, 5)]
    ranges = [(d, s, s + r.randint(1, 200)) for d in (1, 2, 3) for s in r.sample(range(700), 60)] + [(1, 5000, 5001), (None, 0, 5)]
    found = M.map_via_spans(spark.createDataFrame(ranges, "doc long, norm_start long, norm_end long"), spark.createDataFrame(spans, "doc long, norm_start long, norm_end long, orig_start long, orig_end long"), ["doc"])
    got = {(x.doc, x.norm_start, x.norm_end): (x.orig_start, x.orig_end) for x in found.collect()}
    for d, a, z in ranges:
        hit = [s for s in spans if s[0] == d and d is not None and s[2] > a and s[1] < z]
        assert got[d, a, z] == ((min(s[3] for s in hit), max(s[4] for s in hit)) if hit else (a, z))

    words = [(d, s, s + r.randint(1, 20)) for d in (1, 2, 3) for s in r.sample(range(600), 50)]
    rendered = [(d, i, a, z) for i, (d, a, z, _, _) in enumerate(spans) if d]
    found = M.tightest_span(spark.createDataFrame(words, "doc long, s long, e long"), spark.createDataFrame(rendered, "doc long, span long, start long, end long"), ["doc"])
    got = {(x.doc, x.s, x.e): x.span for x in found.collect()}
    for d, s, e in words:
        around = [((a, z) != (s, e), z - a, i) for k, i, a, z in rendered if k == d and a <= s and z >= e]
        assert got[d, s, e] == (min(around)[2] if around else None)


def test_cells_make_up_a_range(spark):
    r = random.Random(7)
    ranges = [(a, a + n) for a in (0, 1, 63, 64, 500, 4095, 10**6, -70) for n in (0, 1, 64, 65, 512, 1000, 4096, 33_000, 10**6)] + [(r.randrange(10**7), r.randrange(10**7, 2 * 10**7)) for _ in range(20)]
    df = spark.createDataFrame(ranges, "a long, z long")
    for row in df.select("a", "z", M._cover(F.col("a"), F.col("z")).alias("cover")).collect():
        low, high = row.a // 64, max(row.a // 64, (row.z - 1) // 64)
        cells = sorted(((c.node << 3 * c.level), (c.node + 1 << 3 * c.level) - 1) for c in row.cover)
        assert cells[0][0] == low and cells[-1][1] == high and all(x[1] + 1 == y[0] for x, y in zip(cells, cells[1:]))
        assert len(cells) <= 14 * 9


def test_nested_spans_over_a_million_characters(spark):
    import numpy as np

    r = random.Random(8)
    spans = [(1, 250 * i, 10**6 - 250 * i, 7 * i, 10**7 - i) for i in range(2000)] + [(1, a, a + r.randint(1, 400), 3 * a, 3 * a + 5) for a in r.sample(range(10**6), 3000)]
    ranges = [(1, a, a + n) for a in r.sample(range(-1000, 10**6 + 1000), 1500) for n in (1, r.randint(2, 200_000))]
    spans_df = spark.createDataFrame(spans, "doc long, norm_start long, norm_end long, orig_start long, orig_end long").repartition(4)
    assert M._celled(spans_df.selectExpr("doc", "norm_start", "norm_end"), M._cover(F.col("norm_start"), F.col("norm_end")), "x").count() < 40 * len(spans)
    found = M.map_via_spans(spark.createDataFrame(ranges, "doc long, norm_start long, norm_end long"), spans_df, ["doc"])
    got = {(x.norm_start, x.norm_end): (x.orig_start, x.orig_end) for x in found.collect()}
    _, ss, se, os, oe = (np.array(x) for x in zip(*spans))
    for _, a, z in ranges:
        hit = (se > a) & (ss < z)
        assert got[a, z] == ((os[hit].min(), oe[hit].max()) if hit.any() else (a, z))
    rendered = spark.createDataFrame([(1, i, x[1], x[2]) for i, x in enumerate(spans)], "doc long, span long, start long, end long")
    words = [(1, a, a + r.randint(1, 30)) for a in r.sample(range(10**6), 1000)]
    around = M.tightest_span(spark.createDataFrame(words, "doc long, s long, e long"), rendered, ["doc"])
    for x in around.collect():
        fits = np.flatnonzero((ss <= x.s) & (se >= x.e))
        exact = [int(i) for i in fits if (ss[i], se[i]) == (x.s, x.e)]
        best = min(exact, default=None) if exact else min(fits.tolist(), key=lambda i: (se[i] - ss[i], i), default=None)
        assert x.span == best


def test_active_words_over_many_stretches(spark):
    words = [(1, i, float(10 * i + 8)) for i in range(40)] + [(2, 0, 5.0)]
    times = [(1, t / 2) for t in range(0, 900, 3)] + [(2, 5.0), (2, 4.9), (3, 1.0), (1, 8.0), (1, 8.0)]
    found = M.active_words(spark.createDataFrame(times, "doc long, t double"), spark.createDataFrame(words, "doc long, idx long, end double"), ["doc"], stretch=50)
    got = {(x.doc, x.t): x.active for x in found.collect()}
    for d, t in times:
        assert got[d, t] == min((i for k, i, end in words if k == d and end > t), default=-1)


def test_maps_by_shape(spark):
    schema = "spans array<struct<norm_start:int,norm_end:int,orig_start:int,orig_end:int>>, char_map array<struct<s:int,e:int>>"
    rows = [([(0, 4, 10, 14), (4, 6, 20, 22)], None), (None, [(5, 6), (7, 9)]), (None, None), ([], [(1, 2)])]
    df = spark.createDataFrame(rows, schema)
    found = df.select(M.map_to_original({"spans": F.col("spans"), "char_map": F.col("char_map")}, F.lit(1), F.lit(5)).alias("x")).collect()
    assert [tuple(r.x) for r in found] == [(10, 22), (7, 9), (1, 5), (1, 5)]


def test_source_positions(spark):
    edits = spark.createDataFrame([(1, 2, 5, 1), (1, 8, 9, 4)], "doc long, orig_start long, orig_end long, new_len int")
    points = spark.createDataFrame([(1, i) for i in range(12)] + [(2, 3)], "doc long, at long")
    got = {(x.doc, x.at): (x.source, x.inside) for x in M.source_positions(points, edits, ["doc"]).collect()}
    assert [got[1, i] for i in range(12)] == [(0, False), (1, False), (2, True), (5, False), (6, False), (7, False), (8, True), (8, True), (8, True), (8, True), (9, False), (10, False)]
    assert got[2, 3] == (3, False)
    assert M.source_positions(points.limit(0), edits, ["doc"]).count() == 0


def test_ranges_of_maps(spark):
    df = spark.createDataFrame([([(3, 4), (1, 2), (5, 9)], 0, 2), ([(3, 4)], 4, 9), ([], 1, 2)], "m array<struct<s:int,e:int>>, a int, z int")
    both = df.select(M.bounding_range(F.col("m"), F.col("a"), F.col("z")).alias("x"), M.map_positional(F.col("m"), F.col("a"), F.col("z")).alias("y")).collect()
    assert [tuple(r.x) for r in both] == [(1, 4), (3, 4), (1, 2)] and [tuple(r.y) for r in both] == [(3, 2), (3, 4), (1, 2)]
    around = spark.range(1).select(M.word_around(F.lit("ab cde f"), F.lit(4)).alias("x")).first().x
    assert tuple(around) == (3, 6)


def test_cells_are_dealt_once(spark, tmp_path):
    """What is joined by cell is grouped by cell where it lies, and only hits leave a join."""
    text = " ".join(f"w{i % 37}" for i in range(3000))
    spark.createDataFrame([(k, text) for k in range(20)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for name, most in (("containment", 2), ("map_via_spans", 3)):
            plan = table_queries.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning(doc_id") == most and "LeftOuter, ((" in plan, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_odd_ranges_and_spans_like_brute_force(spark):
    """Ranges and spans of all lengths, empty, ending before they start or at the edges of cells, with nulls and repeated rows."""
    r = random.Random(11)
    edge = lambda top: r.choice([r.randrange(-top // 10, top), 4096 * r.randrange(top // 4096 + 1) + r.choice([-1, 0, 1])])
    size = lambda top: r.choice([0, 0, 1, 2, 10, 4096, r.randrange(top), -r.randrange(1, 50), -r.randrange(top)])
    null = lambda x: None if r.random() < 0.02 else x
    spans, ranges = [], []
    for doc, top in enumerate((300, 20_000, 400_000)):
        spans += [(null(doc), null(a), null(a + size(top)), null(r.randrange(10**6)), null(r.randrange(10**6))) for a in (edge(top) for _ in range(120))]
        ranges += [(null(doc), null(a), null(a + size(top))) for a in (edge(top) for _ in range(200))]
    ranges += [(9, 0, 5), *ranges[:30]]
    spans_df = spark.createDataFrame(spans, "doc int, norm_start long, norm_end long, orig_start int, orig_end long").repartition(3)
    found = M.map_via_spans(spark.createDataFrame(ranges, "doc int, norm_start int, norm_end long").repartition(3), spans_df, ["doc"])
    assert [f.dataType.simpleString() for f in found.schema] == ["int", "int", "bigint", "int", "bigint"]
    want = set()
    for d, a, z in ranges:
        hit = [s for s in spans if None not in (d, z, s[1], s[2]) and s[0] == d and a is not None and s[2] > a and s[1] < z]
        if a is not None:
            want.add((d, a, z, min((s[3] for s in hit if s[3] is not None), default=a), max((s[4] for s in hit if s[4] is not None), default=z)))
    got = [tuple(x) for x in found.collect()]
    assert len(got) == len(want) and set(got) == want


def test_ranges_and_spans_are_dealt_packed(spark):
    """A few bytes are shuffled for each range and span, and none are stored."""
    spans = spark.range(0, 150_000, 1, 4).selectExpr("id div 500 as doc", "id % 500 * 12 as norm_start", "id % 500 * 12 + 4 + pmod(hash(id), 14) as norm_end", "id % 500 * 6 as orig_start", "id % 500 * 6 + 2 + pmod(hash(id), 7) as orig_end")
    ranges = spark.range(0, 150_000, 1, 4).selectExpr("id div 500 as doc", "id % 500 * 14 as norm_start", "id % 500 * 14 + 10 as norm_end")

    def stages():
        found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return [found.apply(i) for i in range(found.size())]

    before = {x.stageId() for x in stages()}
    M.map_via_spans(ranges, spans, ["doc"]).write.format("noop").mode("overwrite").save()
    ran = [x for x in stages() if x.stageId() not in before]
    assert sum(x.outputBytes() for x in ran) == 0
    assert sum(x.shuffleWriteBytes() for x in ran) < 8 * 300_000
