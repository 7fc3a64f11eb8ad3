import re

import corpus_pipeline as P
from lectern.llm import quality
from lectern.llm.queries import word_vocabulary
from tests.llm.test_decontamination import brute as hits
from tests.llm.test_pii import brute as spans
from tests.llm.test_simhash import similarity

SF = "/root/testdata/sf0.001"


def test_stages_like_plain_versions(spark):
    """Each stage on its own input: what it drops and keeps follows from the rule alone."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "s", None), (9002, "", "en", "s", 0), (None, "short clean text of no id", "en", "s", 25), (9003, "Write to a.b@c.example.com or call +1 (532) 555-7857 now.", "en", "s", 57)], docs.schema)
    docs = docs.unionByName(extra).cache()
    columns, stages = docs.columns, dict(P.STAGES)
    rows = lambda df: [tuple(r) for r in df.select(*columns).collect()]
    before = rows(docs)

    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    grader = quality.Grader(**model)
    kept = stages["quality"](spark, docs, SF)
    assert kept.columns == columns
    after = rows(kept)
    assert sorted(after, key=repr) == sorted((r for r in before if grader.grade(r[1])[1][-1] >= 0.5), key=repr)

    kept = spark.createDataFrame(after, docs.schema)
    before, after = after, rows(stages["near_duplicates"](spark, kept, SF))
    assert set(after) <= set(before) and len(set(after)) == len(after)
    for r in before:
        if r not in after:
            assert any((r[1] or "") == (x[1] or "") or similarity(r[1], x[1]) > 0.3 for x in after)  # groups are chains of 0.8
    pairs = [(a[0], b[0]) for i, a in enumerate(after) for b in after[:i] if similarity(a[1], b[1]) >= 0.8]
    assert not pairs

    before, kept = after, spark.createDataFrame(after, docs.schema)
    after = rows(stages["decontamination"](spark, kept, SF))
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = [r for r, (_, n, hit, _) in zip(sorted(before, key=lambda r: repr((r[0],))), sorted(hits([(r[0], r[1]) for r in before], items), key=lambda x: repr((x[0],)))) if not (hit and 20 * hit >= n)]
    assert sorted(after, key=repr) == sorted(clean, key=repr)

    before, kept = {r[0]: r for r in after}, spark.createDataFrame(after, docs.schema)
    after = rows(stages["personal_data"](spark, kept, SF))
    for k, text, *_, n in after:
        assert (n if text is not None else 0) == len(text or "")
        assert text == before[k][1] if not spans(before[k][1] or "") and "[IBAN]" not in (text or "") else not spans(text)
    assert "[EMAIL]" in dict((r[0], r[1]) for r in after)[9003]

    packed = stages["packing"](spark, spark.createDataFrame(after, docs.schema), SF).collect()
    from tokenizers import Tokenizer

    tokenizer, ids = Tokenizer.from_file(word_vocabulary()), {}
    for r in sorted(packed, key=lambda r: r.start):
        ids.setdefault(r.doc_id, []).extend(r.ids)
    assert ids == {r[0]: [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in after}


def test_contract():
    assert [x for x, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]
    assert not re.search("localCheckpoint|collect\\(", open(P.__file__).read())


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0


def test_clashing_columns_long_texts_and_repeated_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    long = " ".join(f"clean word{i % 9000} of {i % 77} the text." for i in range(40_000))
    extra = spark.createDataFrame([(9001, long, "en", "s", len(long)), (9002, "a" * 500_000, "en", "s", 500_000), (9003, long, None, None, None), (9003, long, None, None, None), (None, None, None, None, None)], docs.schema)
    clashing = ("graded", "Graded_", "key", "node", "group", "id", "n_hit", "bucket", "ids", "length", "sequence_id", "item_id", "quality", "spans")
    docs = docs.unionByName(extra)
    docs = docs.select("*", *[docs.doc_id.cast("string").alias(x) for x in clashing])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    before = docs
    for name, stage in P.STAGES[:-1]:
        after = spark.createDataFrame(stage(spark, before, str(tmp_path)).collect(), docs.schema)
        assert after.columns == docs.columns and after.count() <= before.count(), name
        before = after
    found = {(r.doc_id, r.start, r.sequence_id, r.offset) for r in P.run(spark, str(tmp_path)).collect()}
    assert len({x[2:] for x in found}) == len(found)
    assert {x[0] for x in found} == {r.doc_id for r in before.collect()}
    assert sum(x[0] == 9003 for x in found) == 0  # a copy of 9001
