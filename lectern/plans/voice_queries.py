"""Queries of what comes before and after a voice: tokens, stress marks, homographs, bands of samples.

The texts of documents are Latin, so a letter of the Cyrillic alphabet stands for each of theirs, and a rule for the models' answers.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import strings as S
from lectern.operators import extraction as X
from lectern.operators import samples as A
from lectern.operators import voice as V
from lectern.operators.words import spans
from lectern.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


LATIN, CYRILLIC = "abcdefghijklmnopqrstuvwxyz+", "абцдефгхийклмнопярстуввхуз"
READ_SQL = f"d AS (SELECT doc_id, translate(lower(text), '{LATIN}', '{CYRILLIC}') AS t FROM documents)"


def _read(text: Column) -> Column:
    return F.translate(F.lower(text), LATIN, CYRILLIC)


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", _read(F.col("text")).alias("text"))


_SIGN = S.PUNCTUATION


@query(
    rf"""WITH w AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '([{S.IDEOGRAPHS}])', ' \1 ', 'g'), '[{_SIGN}]|[^{_SIGN}{S.WHITE}]+') AS w FROM documents)
    SELECT doc_id, CAST(len(w) AS INTEGER) AS n, md5(array_to_string(w, ' ')) AS digest FROM w"""
)
def basic_tokens(spark: SparkSession, sf: str) -> DataFrame:
    tokens = S.basic_tokens(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", tokens.alias("w")).select("doc_id", F.size("w").alias("n"), F.md5(F.array_join("w", " ").cast("binary")).alias("digest"))


@query(
    rf"""WITH {READ_SQL}, w AS (SELECT unnest(regexp_extract_all(t, '[{S.WHITE}]+|[^{S.WHITE}-]*-|[^{S.WHITE}-]+')) AS raw FROM d)
    SELECT raw, regexp_replace(raw, '[^а-яё]', '', 'g') AS clean, regexp_matches(raw, '[а-яё]') AS placed, count(*) AS n FROM w GROUP BY raw"""
)
def accent_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Signs are counted before they are cleaned, so each different one is cleaned once."""
    return V.counted_tokens(_documents(spark, sf), "text")


@query(rf"WITH {READ_SQL} SELECT doc_id, regexp_replace(t, '([^{S.WHITE}{V.VOWELS}-]*)([{V.VOWELS}])([^{S.WHITE}-]*-?)', '\1+\2\3', 'g') AS voiced FROM d")
def accentuate(spark: SparkSession, sf: str) -> DataFrame:
    """The model here stresses the first vowel of every word."""
    docs = _documents(spark, sf)
    words = V.counted_tokens(docs, "text").where("placed").select(F.col("clean").alias("word")).distinct()
    answers = words.select("word", F.lit(0).alias("vowel"), F.lit(0.9).alias("chance"), F.lit(0).alias("yo"), F.lit(0.0).alias("yo_chance"))
    exceptions = spark.createDataFrame([], "word string, stress int, yo int")
    return V.accentuate(docs, exceptions, answers).select("doc_id", "voiced")


@query(
    """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations), s AS (SELECT word, '<' || word || '>' AS p, unnest([1, 2]) AS n FROM w),
    g AS (SELECT word, n, spot, substr(p, spot, n) AS gram FROM (SELECT *, unnest(range(1, length(p) - n + 2)) AS spot FROM s))
    SELECT word, list(CAST(CASE WHEN n = 1 THEN ascii(gram) - 97 ELSE 26 + 26 * (ascii(gram) - 97) + ascii(substr(gram, 2)) - 97 END AS BIGINT) ORDER BY n, spot) AS ids FROM g WHERE regexp_full_match(gram, '[a-z]+') GROUP BY word"""
)
def ngram_inputs(spark: SparkSession, sf: str) -> DataFrame:
    letter = lambda k: F.chr(k + 97)
    singles = spark.range(26).select(letter(F.col("id")).alias("gram"), "id")
    pairs = spark.range(676).select(F.concat(letter(F.floor(F.col("id") / 26)), letter(F.col("id") % 26)).alias("gram"), (F.col("id") + 26).alias("id"))
    words = table(spark, sf, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return V.ngram_ids(words, singles.unionByName(pairs), -1)


@query(
    rf"""WITH {READ_SQL}, p AS (SELECT doc_id, regexp_extract_all(t, '[а-яё]+') AS w, regexp_split_to_array(t, '[а-яё]+') AS g FROM d),
    e AS (SELECT doc_id, unnest(range(0, len(w))) AS idx, unnest(w) AS word, unnest(g[1 : len(w)]) AS gap FROM p),
    s AS (SELECT doc_id, idx, word, CAST(sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY idx) AS BIGINT) AS end_pos FROM e)
    SELECT doc_id, CAST(idx AS INTEGER) AS idx, word, end_pos - length(word) AS start, end_pos, CASE word WHEN 'тхе' THEN 'т+хе' ELSE 'д+е' END AS variant FROM s WHERE word IN ('тхе', 'де')"""
)
def homographs(spark: SparkSession, sf: str) -> DataFrame:
    """The model here names the first variant of every homograph."""
    known = spark.createDataFrame([("тхе", ["тх+е", "т+хе"]), ("де", ["д+е"])], "word string, variants array<string>")
    return V.homograph_words(_documents(spark, sf), known).withColumn("variant", V.choose_variant(F.col("variants"), F.lit(-2.0))).drop("variants")


_THE = r"'(^|[^а-яё])тхе([^а-яё]|$)', '\1т+хе\2', 'g'"


@query(f"WITH {READ_SQL} SELECT doc_id, regexp_replace(regexp_replace(t, {_THE}), {_THE}) AS resolved FROM d")
def resolved_homographs(spark: SparkSession, sf: str) -> DataFrame:
    docs = _documents(spark, sf)
    known = spark.createDataFrame([("тхе", ["тх+е", "т+хе"])], "word string, variants array<string>")
    found = V.homograph_words(docs, known).withColumn("variant", V.choose_variant(F.col("variants"), F.lit(-2.0)))
    choices = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end_pos", "variant"))).alias("choices"))
    return docs.join(choices, "doc_id", "left").select("doc_id", V.resolve_homographs(F.col("text"), F.col("choices")).alias("resolved"))


_TOKENS = "[A-Za-z]+"


@query(
    f"""WITH p AS (SELECT doc_id, regexp_extract_all(text, '{_TOKENS}') AS w, regexp_split_to_array(text, '{_TOKENS}') AS g FROM documents),
    e AS (SELECT doc_id, unnest(range(0, len(w))) AS idx, unnest(w) AS word, unnest(g[1 : len(w)]) AS gap FROM p),
    s AS (SELECT doc_id, word, CAST(sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY idx) AS BIGINT) AS end_pos FROM e)
    SELECT doc_id, word, CAST(end_pos - length(word) AS INTEGER) AS start, CAST(end_pos AS INTEGER) AS "end" FROM s"""
)
def rendered_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of Latin letters stand for the text tokens of a rendered page; each is found again in its source."""
    each = spans(table(spark, sf, "documents"), ["doc_id"], "text", lambda t: X.place_spans(t, re.findall(_TOKENS, t)))
    return each.select("doc_id", "word", F.col("start").cast("int").alias("start"), F.col("end_pos").cast("int").alias("end"))


_BAND = A.band_filter(*A.BANDS[24000])[0].tolist()


@query(
    f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), h AS (SELECT {_BAND}::DOUBLE[] AS h),
    p AS (SELECT vec_id, list_concat(list_transform(range(0, 31), lambda x: 0.0::DOUBLE), v, list_transform(range(0, 31), lambda x: 0.0::DOUBLE)) AS p, h FROM e, h)
    SELECT vec_id, list_transform(range(0, CAST(ceil((len(p) - 62) / 2.0) AS BIGINT)), lambda k: round(list_inner_product(p[2 * k + 1 : 2 * k + 63], h), 6)) AS samples FROM p"""
)
def lowest_band(spark: SparkSession, sf: str) -> DataFrame:
    """Components are below one half, so no band exceeds one."""
    return table(spark, sf, "embeddings").select("vec_id", A.rounded(A.to_lowest_band(F.col("embedding").cast("array<double>"), 24000), 6).alias("samples"))
