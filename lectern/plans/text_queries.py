"""Cleaners, splitters and word tables over the text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import lexicon as L
from lectern.functions import strings as S
from lectern.functions import urls as U
from lectern.operators import history as H
from lectern.operators import words as W
from lectern.plans import sqltext as Q
from lectern.sources.tables import table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


WORDS_SQL = f"""
docs AS (SELECT doc_id, lang, n_chars, regexp_extract_all(text, '{S.WORD}') AS w, regexp_split_to_array(text, '{S.WORD}') AS g FROM documents),
each AS (SELECT doc_id, lang, n_chars, unnest(range(0, len(w))) AS idx, unnest(w) AS word, unnest(g[1 : len(w)]) AS gap FROM docs),
words AS (SELECT doc_id, lang, n_chars, idx, word, CAST(sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY idx) AS BIGINT) - length(word) AS s FROM each)"""


@query(f"WITH {WORDS_SQL} SELECT doc_id, CAST(idx AS INTEGER) AS idx, word, s AS start, s + length(word) AS end_pos FROM words")
def word_spans(spark: SparkSession, sf: str) -> DataFrame:
    return W.word_spans(table(spark, sf, "documents")).select("doc_id", "idx", "word", "start", "end_pos")


TIMES_SQL = f"""{WORDS_SQL},
timed AS (SELECT *, CAST(sum(length(word)) OVER (PARTITION BY doc_id ORDER BY idx) AS BIGINT) AS upto, CAST(sum(length(word)) OVER (PARTITION BY doc_id) AS BIGINT) AS total, n_chars * 60 AS ms FROM words),
times AS (SELECT doc_id, lang, idx, word, ((upto - length(word)) * ms * 2 + total) // (2 * total) AS start_ms, (upto * ms * 2 + total) // (2 * total) AS end_ms FROM timed)"""


@query(f"WITH {TIMES_SQL} SELECT doc_id, CAST(idx AS INTEGER) AS idx, word, start_ms, end_ms FROM times")
def word_times(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return W.word_times(W.word_spans(docs, keep=("n_chars",)), F.col("n_chars") * 60).select("doc_id", "idx", "word", "start_ms", "end_ms")


@query(f"WITH {TIMES_SQL} SELECT lang, CAST(count(*) AS BIGINT) AS words, CAST(sum(end_ms - start_ms) AS BIGINT) AS spoken_ms, CAST(max(end_ms) AS BIGINT) AS longest_ms FROM times GROUP BY lang")
def word_time_summary(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    times = W.word_times(W.word_spans(docs, keep=("lang", "n_chars")), F.col("n_chars") * 60)
    return times.groupBy("lang").agg(F.count("*").alias("words"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("spoken_ms"), F.max("end_ms").alias("longest_ms"))


@query(
    """WITH lines AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line, unnest(string_split(text, chr(10))) AS t FROM documents)
    SELECT doc_id, CAST(line AS INTEGER) AS line, t AS text, CAST(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY line) AS BIGINT) - length(t) - 1 AS start FROM lines"""
)
def line_spans(spark: SparkSession, sf: str) -> DataFrame:
    return W.line_spans(table(spark, sf, "documents"))


@query(
    """WITH t AS (SELECT conv_id, turn, unnest(range(0, len(string_split(text, ' ')))) AS k, unnest(string_split(text, ' ')) AS w FROM conversations),
    s AS (SELECT *, CAST(sum(length(w) + 1) OVER (PARTITION BY conv_id, turn ORDER BY k) AS BIGINT) - length(w) - 1 AS start FROM t)
    SELECT conv_id, turn, w AS word, start, start + length(w) AS end_pos FROM s WHERE w <> ''"""
)
def space_word_spans(spark: SparkSession, sf: str) -> DataFrame:
    return W.space_word_spans(table(spark, sf, "conversations"), ["conv_id", "turn"]).select("conv_id", "turn", "word", "start", "end_pos")


@query("SELECT DISTINCT w AS word, CAST(len(g) AS INTEGER) AS n_grams, list_aggregate(g, 'string_agg', ' ') AS grams FROM (SELECT w, flatten(list_transform(range(1, length(w) + 3), lambda n: list_transform(range(1, length(w) + 4 - n), lambda i: substr('<' || w || '>', i, n)))) AS g FROM (SELECT DISTINCT unnest(string_split(lower(o_orderpriority), '-')) AS w FROM orders))")
def ngrams(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "orders").select(F.explode(F.split(F.lower("o_orderpriority"), "-")).alias("word")).distinct()
    grams = words.withColumn("grams", S.char_ngrams(F.col("word")))
    return grams.select("word", F.size("grams").alias("n_grams"), F.array_join("grams", " ").alias("grams"))


@query(r"SELECT conv_id, turn, regexp_replace(text, '[.,;:!?]*$', '') AS core, regexp_extract(text, '[.,;:!?]*$') AS suffix FROM conversations")
def trailing_punct(spark: SparkSession, sf: str) -> DataFrame:
    core, suffix = S.split_trailing_punct(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", core.alias("core"), suffix.alias("suffix"))


@query(
    rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[{S.WHITE}]*\n[{S.WHITE}]*', ' ', 'g'), ' +', ' ', 'g'), '\A[{S.WHITE}]+|[{S.WHITE}]+\z', '', 'g') AS clean FROM documents"""
)
def sanitize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", S.sanitize(F.col("text")).alias("clean"))


@query(r"SELECT page_id, regexp_replace(html, '(?s)\[\[.*?(?:\]\]|\z)|<[A-Za-z/][^>]*>', '', 'g') AS plain FROM pages")
def strip_markup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", S.strip_markup(F.col("html")).alias("plain"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM pages")
def escape_html(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", S.escape_html(F.col("html")).alias("escaped"))


@query("SELECT doc_id, substr(text, 1, 60) || CASE WHEN length(text) > 60 THEN '…' ELSE '' END AS preview FROM documents")
def preview_60(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", S.preview(F.col("text")).alias("preview"))


@query("SELECT doc_id AS id, text AS original_text FROM documents WHERE contains(lower(text), 'license')")
def search_entries(spark: SparkSession, sf: str) -> DataFrame:
    return H.search(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("original_text")), "  LICENSE ")


@query("SELECT doc_id, source, NOT (source IN ('src0', 'src1') AND length(text) > 10000) AS accepted FROM documents")
def length_guard(spark: SparkSession, sf: str) -> DataFrame:
    """One engine takes texts up to a length, here two sources stand for it."""
    return table(spark, sf, "documents").select("doc_id", "source", (~H.too_long(F.col("text"), F.col("source"), 10000, ("src0", "src1"))).alias("accepted"))


_GROUPS = "|".join(sorted(L.TRANSLITERATION, key=lambda x: (-len(x), x)))


@query(
    f"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM conversations)
    SELECT word, list_aggregate(list_transform(regexp_extract_all(word, '{_GROUPS}'), lambda g: {Q.mapping(L.TRANSLITERATION)}[g]), 'string_agg', '') AS reading FROM w"""
)
def transliterate(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct word is read once, whatever its frequency."""
    words = table(spark, sf, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", S.transliterate(F.col("word")).alias("reading"))


@query(
    r"""SELECT page_id, list_filter(string_split(k, '-'), lambda p: p <> '') AS kebab, list_filter(string_split(k, '_'), lambda p: p <> '') AS snake
    FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || '_' || coalesce(regexp_extract(url, '[?](.*)$', 1), '') AS k FROM pages)"""
)
def identifier_split(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1), F.lit("_"), F.regexp_extract("url", r"[?](.*)$", 1))
    pages = table(spark, sf, "pages").select("page_id", name.alias("name"))
    return pages.select("page_id", S.split_kebab_case(F.col("name")).alias("kebab"), S.split_snake_case(F.col("name")).alias("snake"))


@query(
"SELECT page_id, list_concat([100], list_filter(list_transform(string_split(lower(url), ''), lambda c: strpos('abcdefghijklmnopqrstuvwxyz', c)), lambda k: k > 0), [101]) AS ids FROM pages"
)
def sequence_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.transform(S.symbol_sequence(F.col("url"), "abcdefghijklmnopqrstuvwxyz", 100, 101), lambda x: x.cast("long")).alias("ids"))


@query("SELECT p_partkey, replace(lower(p_name || ' Ёж ё'), 'ё', 'е') AS letter_key FROM part")
def letter_key(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", S.letter_key(F.concat("p_name", F.lit(" Ёж ё"))).alias("letter_key"))


@query()
def host_words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("url").distinct().select("url", U.url_reading(F.col("url")).alias("words"))


@query(r"""SELECT page_id, url_decode(regexp_extract(url, '^[^?#]*')) AS decoded FROM pages""")
def percent_decoded(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", U.percent_decode(F.regexp_extract("url", "^[^?#]*", 0)).alias("decoded"))


@query(
    r"""WITH s AS (SELECT conv_id, turn, regexp_replace(translate(lower(text), '—', '–'), '[^!+,\-.:;?абвгдежзийклмнопрстуфхцчшщъыьэюяё–… ]', '', 'g') AS x FROM conversations)
    SELECT conv_id, turn, trim(regexp_replace(x, ' +', ' ', 'g')) AS sentence, regexp_replace(trim(regexp_replace(x, ' +', ' ', 'g')), '[^а-я\- ]', '', 'g') AS clean_sentence,
           length(replace(regexp_replace(trim(regexp_replace(x, ' +', ' ', 'g')), '[^а-я\- ]', '', 'g'), ' ', '')) > 0 AS has_text FROM s"""
)
def voice_input(spark: SparkSession, sf: str) -> DataFrame:
    """Carets, which only a caller sets, are left out; tests cover them."""
    text = F.replace("text", F.lit("^"), F.lit(""))
    return table(spark, sf, "conversations").select("conv_id", "turn", S.voice_input(text).alias("x")).select("conv_id", "turn", "x.*")


@query()
def normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Speakable text of every document, with how much of it was rewritten."""
    from lectern.plans.normalize import spoken

    return spoken(table(spark, sf, "documents"))


@query()
def html_word_spans(spark: SparkSession, sf: str) -> DataFrame:
    from lectern.operators.extraction import html_words

    each = table(spark, sf, "pages").select("page_id", F.posexplode(html_words(F.col("html"))).alias("idx", "w"))
    return each.select("page_id", "idx", "w.word", "w.start", F.col("w.end").alias("end_pos"))


@query()
def markdown_words(spark: SparkSession, sf: str) -> DataFrame:
    from lectern.operators import markdown
    from lectern.operators.words import spans

    each = spans(table(spark, sf, "documents"), ["doc_id"], "text", markdown.word_spans)
    return each.select("doc_id", "idx", "word", F.col("start").cast("int").alias("start"), F.col("end_pos").cast("int").alias("end_pos"))


PHRASES_SQL = r"""WITH
b AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
dict AS (SELECT term, min(said) AS said FROM (SELECT array_to_string(w[i : i + n - 1], ' ') AS term, CAST(item_id AS VARCHAR) AS said FROM b, (SELECT unnest([1, 2, 3]) AS n), LATERAL (SELECT unnest(range(1, greatest(1, len(w) - n + 2))) AS i) WHERE n > 1 OR i = 1) WHERE term <> '' GROUP BY term),
docs AS (SELECT doc_id, regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w, regexp_split_to_array(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS g FROM documents),
each AS (SELECT doc_id, unnest(range(0, len(w))) AS idx, lower(unnest(w)) AS word, unnest(g[1 : len(w)]) AS gap FROM docs),
words AS (SELECT doc_id, idx, word, CAST(sum(length(gap) + length(word)) OVER p AS BIGINT) - length(word) AS s, lead(word) OVER p AS w2, lead(gap) OVER p AS g2, lead(word, 2) OVER p AS w3, lead(gap, 2) OVER p AS g3 FROM each WINDOW p AS (PARTITION BY doc_id ORDER BY idx)),
runs AS (SELECT doc_id, s, word, CASE WHEN regexp_full_match(g2, '[ \t\n\r\x0B\x0C]*') THEN word || ' ' || w2 END AS two, CASE WHEN regexp_full_match(g2, '[ \t\n\r\x0B\x0C]*') AND regexp_full_match(g3, '[ \t\n\r\x0B\x0C]*') THEN word || ' ' || w2 || ' ' || w3 END AS three,
                length(word) AS l1, length(word) + length(g2) + length(w2) AS l2, length(word) + length(g2) + length(w2) + length(g3) + length(w3) AS l3 FROM words)
SELECT doc_id, CAST(s AS INTEGER) AS start, CAST(s + CASE WHEN c.term IS NOT NULL THEN l3 WHEN b.term IS NOT NULL THEN l2 ELSE l1 END AS INTEGER) AS end_pos, coalesce(c.term, b.term, a.term) AS term, coalesce(c.said, b.said, a.said) AS said
FROM runs LEFT JOIN dict a ON a.term = word LEFT JOIN dict b ON b.term = two LEFT JOIN dict c ON c.term = three WHERE coalesce(c.term, b.term, a.term) IS NOT NULL"""


@query(PHRASES_SQL)
def phrase_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases of benchmark items (their first word, and all runs of two and three) in documents, the longest at each place."""
    from lectern.operators import dictionary as D

    words = table(spark, sf, "benchmark").select("item_id", D.words_of(F.col("text")).alias("w"))
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), " "))
    terms = words.select(F.explode(F.concat(F.slice("w", 1, 1), F.when(F.size("w") > 1, runs(2)).otherwise(F.array()), F.when(F.size("w") > 2, runs(3)).otherwise(F.array()))).alias("term"), F.col("item_id").cast("string").alias("said"))
    found = D.find_phrases(table(spark, sf, "documents"), terms, overlapping=True)
    return found.select(F.col("id").alias("doc_id"), "start", F.col("end").alias("end_pos"), "term", "said")


ENGLISH_SQL = f"""WITH
w AS (SELECT DISTINCT word, lower(word) AS low FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents) WHERE length(word) > 1),
custom AS (SELECT low, min(said) AS said FROM (SELECT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS low, 'item ' || item_id AS said FROM benchmark WHERE item_id % 2 = 0) GROUP BY low),
x AS (SELECT word, low, {Q.mapping(L.PHRASES)}[low] AS p, c.said AS c, {Q.mapping(L.TERMS)}[low] AS t FROM w LEFT JOIN custom c USING (low))
SELECT word, coalesce(p, c, t, list_aggregate(list_transform(regexp_extract_all(low, '{"|".join(sorted(L.TRANSLITERATION, key=lambda x: (-len(x), x)))}'), lambda g: {Q.mapping(L.TRANSLITERATION)}[g]), 'string_agg', '')) AS said,
       CASE WHEN p IS NOT NULL THEN 'phrase' WHEN c IS NOT NULL THEN 'custom' WHEN t IS NOT NULL THEN 'term' ELSE 'letters' END AS by
FROM x"""


@query(ENGLISH_SQL)
def english_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Readings of the different Latin words of documents; the terms of one's own are the words of even benchmark items."""
    from lectern.operators import dictionary as D

    latin = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))
    words = table(spark, sf, "documents").select(latin.alias("word")).where("length(word) > 1")
    items = table(spark, sf, "benchmark").where("item_id % 2 = 0")
    custom = items.select(latin.alias("term"), F.concat(F.lit("item "), "item_id").alias("said"))
    return D.read_english(words, custom=custom)


@query()
def resolved_links(spark: SparkSession, sf: str) -> DataFrame:
    """The targets of a page's links, as they stand and resolved against its URL."""
    links = table(spark, sf, "pages").select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit("(?:href|src)=\"([^\"]*)\""), F.lit(1))).alias("idx", "target"))
    return links.select("page_id", "idx", "target", U.resolve_url(F.col("target"), F.col("url")).alias("resolved"))


@query()
def sanitized_html(spark: SparkSession, sf: str) -> DataFrame:
    from lectern.operators.extraction import html_to_text
    from lectern.operators.markup import sanitized, words_wrapped

    clean = table(spark, sf, "pages").select("page_id", sanitized(F.col("html")).alias("clean"))
    return clean.select("page_id", "clean", words_wrapped(F.col("clean")).alias("wrapped"), html_to_text(F.col("clean")).alias("text"))


@query()
def html_text(spark: SparkSession, sf: str) -> DataFrame:
    from lectern.operators.extraction import html_to_text

    return table(spark, sf, "pages").select("page_id", html_to_text(F.col("html")).alias("text"))


@query()
def chunk_split(spark: SparkSession, sf: str) -> DataFrame:
    from lectern.operators.extraction import chunks

    docs = table(spark, sf, "documents").select("doc_id", F.posexplode(chunks(F.col("text"))).alias("idx", "chunk"))
    return docs.select("doc_id", "idx", "chunk.text", "chunk.start")


@query()
def chunk_refit(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of which the longest are cut again to fit."""
    from lectern.operators.extraction import chunks

    docs = table(spark, sf, "documents").select("doc_id", F.posexplode(chunks(F.col("text"), most=700)).alias("idx", "chunk"))
    return docs.select("doc_id", "idx", "chunk.text", "chunk.start")


@query()
def aligned_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words of turns in a stream of symbols that has a frame or more for every letter, but none for those of one word in seven."""
    from lectern.operators.extraction import aligned_words as align

    rows = table(spark, sf, "conversations").where("text IS NOT NULL")
    dropped = F.regexp_replace("text", r"\b[A-Za-z]{7}\b", "")
    symbols = F.transform(S.characters(dropped), lambda c: F.struct(c.alias("ch"), (F.ascii(c) % 5 + 1).alias("frames")))
    found = rows.select("conv_id", "turn", F.posexplode(align(F.col("text"), symbols, F.col("turn") * 10.0, F.lit(1e6), F.lit(0))).alias("idx", "w"))
    return found.select("conv_id", "turn", "idx", "w.*")


@query()
def wordpiece(spark: SparkSession, sf: str) -> DataFrame:
    from lectern.operators.extraction import wordpiece_ids

    vocabulary = ["[UNK]", "[CLS]", "[SEP]", *"abcdefghijklmnopqrstuvwxyz", *(f"##{c}" for c in "abcdefghijklmnopqrstuvwxyz"), "the", "##ing", "##tion", "an", "##er", "##ed", ".", ","]
    return table(spark, sf, "conversations").select("conv_id", "turn", wordpiece_ids(F.lower("text"), vocabulary).alias("ids"))
