"""The queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, decontamination, packing, pii, quality, repeats, search, simhash, topk, toxicity, trie, urls, warc
from lectern.llm.learning import held_out
from lectern.session import settle
from lectern.sources.tables import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    text = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), text.alias("fingerprint"), "component_id")


#: (host, path, verdict)
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urls.judge(table(spark, sf_dir, "pages"), urls.rule_table(spark, URL_RULES))
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), word_vocabulary()).withColumnRenamed("id", "doc_id")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").alias("n_offending"),
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    found = warc.capture_history(pages)
    return found.select(F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in pii.BASE]
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"), F.transform("spans", lambda s: s["score"]).alias("scores"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(F.col("id").alias("doc_id"), "expected_grade", "chance", "keep")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontamination.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode(table(spark, sf_dir, "documents"), word_vocabulary(), decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


#: Conversations of a family begin alike, with up to so many turns less one of the first of them.
FAMILY, SHARED = 20, 4


def rebuilt_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps, convs): every conversation with its first turns taken from the first of its family, as stored tables of trie.prefix_trie()."""
    steps = settle(trie.turn_keys(conversations), "turns")
    lengths = steps.groupBy("conv").agg(F.count("*").alias("n"))
    base, shared = F.col("conv") - F.col("conv") % FAMILY, F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED
    convs = lengths.withColumns({"base": base, "h": shared})
    convs = convs.join(lengths.select(F.col("conv").alias("base"), F.col("n").alias("n_base")), "base", "left")
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = settle(convs.select("conv", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "conversations")
    own = trie._split_join(steps, convs.select("conv", "h", "taken"), "conv").where("pos >= h")
    own = own.select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "key", "weight")
    first = steps.where(F.col("pos") < SHARED).withColumnRenamed("conv", "base")
    given = convs.select("conv", "base", "h").join(first, "base").where("pos < h").select("conv", "pos", "key", "weight")
    return settle(own.unionByName(given), "steps"), convs.select("conv", "length")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trie.prefix_trie(*rebuilt_conversations(table(spark, sf_dir, "conversations")))
    return found.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


QUERIES = {"op1_simhash": op1_simhash, "op2_url_filter": op2_url_filter, "op3_packing": op3_packing, "op4_toxicity": op4_toxicity, "op5_warc": op5_warc, "op6_pii": op6_pii, "op7_top_k": op7_top_k, "op8_repeats": op8_repeats, "op9_quality": op9_quality, "op10_decontamination": op10_decontamination, "op11_bpe": op11_bpe, "op12_prefix_trie": op12_prefix_trie, "op13_search": op13_search}
OP10_SQL = r"""
WITH
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s FROM b, LATERAL (SELECT unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i) WHERE len(w) > 0),
n AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM d, n, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - n + 2))) AS i)),
hit AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, i, n FROM hit) h, LATERAL (SELECT unnest(range(i, i + n)) AS p) GROUP BY r),
items AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

OP2_SQL = """
WITH
rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p AS (SELECT row_number() OVER () AS r, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
m AS (SELECT h.r, max_by(struct_pack(rule := rules.host || rules.path, verdict := rules.verdict), length(rules.host || rules.path)) AS best
      FROM h JOIN rules ON (h.host = rules.host OR ends_with(h.host, '.' || rules.host)) AND starts_with(h.path, rules.path) GROUP BY h.r)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, 'allow') AS verdict FROM h LEFT JOIN m USING (r)
"""

OP7_SQL = """
WITH
e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP5_SQL = """
WITH
p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY h HAVING count(*) > 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f USING (h)
"""

OP12_SQL = r"""
WITH
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos,
             sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n, c - c % 20 AS base,
             xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
                 lambda a, x: list_reduce(list_concat([xor(a, x)], CAST(range(8) AS BIGINT[])), lambda b, y: CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END)), 4294967295) % 4 AS h
      FROM t GROUP BY c),
l AS (SELECT n.c, n.base, n.h, least(n.h, coalesce(b.n, 0)) AS p FROM n LEFT JOIN n b ON b.c = n.base),
s AS (SELECT l.c, t.pos - l.h + l.p AS pos, t.k, t.w FROM l JOIN t ON t.c = l.c AND t.pos >= l.h
      UNION ALL SELECT l.c, t.pos, t.k, t.w FROM l JOIN t ON t.c = l.base AND t.pos < l.h),
a AS (SELECT l.c, coalesce(list(s.k ORDER BY s.pos) FILTER (s.k IS NOT NULL), []) AS ks, coalesce(list(s.w ORDER BY s.pos) FILTER (s.k IS NOT NULL), []) AS ws FROM l LEFT JOIN s ON s.c = l.c GROUP BY l.c),
r AS (SELECT c, d, array_to_string(ks[1 : d], ',') AS k, len(ks) AS n, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w FROM a, LATERAL (SELECT unnest(range(0, len(ks) + 1)) AS d)),
m AS (SELECT d, k, min(c) AS node, count(*) AS n_convs, any_value(w) AS w, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = n), '')) AS ends FROM r GROUP BY d, k),
p AS (SELECT r.c, r.d, m.node FROM r JOIN m USING (d, k)),
q AS (SELECT m.*, p.node AS parent FROM m LEFT JOIN p ON p.c = m.node AND p.d = m.d - 1),
x AS (SELECT q.*, (SELECT count(*) FROM q z WHERE z.d = q.d + 1 AND z.parent = q.node) AS n_children FROM q),
u AS (SELECT p.d, p.node, sum((x.n_convs - 1) * x.w) AS saved, count(*) FILTER (x.n_children = 0) AS leaves FROM x JOIN p ON p.c = x.node AND p.d <= x.d GROUP BY p.d, p.node)
SELECT x.node AS conv_id, CAST(x.d AS BIGINT) AS depth, x.parent AS parent_conv_id, CAST(x.n_convs AS BIGINT) AS n_convs, CAST(x.n_children AS BIGINT) AS n_children,
       CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, x.ends AS ends_sha256
FROM x JOIN u ON u.d = x.d AND u.node = x.node
"""

_TERMS_SQL = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '')"
OP13_SQL = f"""
WITH
d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS_SQL} AS w FROM documents),
i AS (SELECT row_number() OVER () AS r, item_id, list_distinct({_TERMS_SQL}) AS w FROM benchmark),
g AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d WHERE len(w) > 0),
it AS (SELECT r AS item, unnest(w) AS term FROM i),
dt AS (SELECT r, any_value(n) AS n, term, count(*) AS tf FROM (SELECT r, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM it) GROUP BY r, term),
df AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM dt, g GROUP BY term),
s AS (SELECT it.item, dt.r, CAST(sum(df.w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score FROM it JOIN dt USING (term) JOIN df USING (term), g GROUP BY it.item, dt.r),
k AS (SELECT s.item, d.doc_id, score, CAST(row_number() OVER (PARTITION BY s.item ORDER BY score DESC, d.doc_id NULLS FIRST) AS INTEGER) AS rank FROM s JOIN d USING (r) WHERE score > 0)
SELECT i.item_id, rank, doc_id, score FROM k JOIN i ON i.r = k.item WHERE rank <= 50
"""

ORACLE_SQL: dict[str, str] = {"op13_search": OP13_SQL, "op12_prefix_trie": OP12_SQL, "op5_warc": OP5_SQL, "op7_top_k": OP7_SQL, "op2_url_filter": OP2_SQL, "op10_decontamination": OP10_SQL}
