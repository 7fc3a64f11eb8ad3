"""Readers of numbers over the numeric and time columns of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import lexicon as L
from lectern.functions import numbers as N
from lectern.functions import strings as S
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


def _distinct(df: DataFrame, column) -> DataFrame:
    """Each value is read once; equal ones meet before the shuffle."""
    return df.select(column.alias("input")).distinct()


@query(f"SELECT n AS input, {Q.words('n')} AS words, {Q.words('n', True)} AS feminine FROM (SELECT DISTINCT CAST(l_quantity AS BIGINT) AS n FROM lineitem)")
def num_words_quantity(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("input")
    return _distinct(table(spark, sf, "lineitem"), F.col("l_quantity").cast("long")).select("input", N.int_words(n).alias("words"), N.int_words(n, True).alias("feminine"))


@query(f"SELECT o_orderkey, {Q.words('o_orderkey * 1000003')} AS words FROM orders")
def num_words_large(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", N.int_words(F.col("o_orderkey") * 1000003).alias("words"))


@query(f"SELECT p_partkey, {Q.decline('p_partkey', ('файл', 'файла', 'файлов'))} AS form FROM part")
def declension(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", N.declension(F.col("p_partkey"), ("файл", "файла", "файлов")).alias("form"))


@query(f"SELECT n || '%' AS input, {Q.words('n')} || ' ' || {Q.decline('n', L.PERCENT)} AS words FROM (SELECT DISTINCT CAST(round(l_discount * 100) AS BIGINT) AS n FROM lineitem)")
def percent_words(spark: SparkSession, sf: str) -> DataFrame:
    texts = _distinct(table(spark, sf, "lineitem"), F.concat(F.round(F.col("l_discount") * 100).cast("long").cast("string"), F.lit("%")))
    return texts.select("input", N.percent_words(F.col("input")).alias("words"))


@query(
    f"SELECT DISTINCT n, {Q.words('n')} || ' ' || {Q.decline('n', L.SIZE_UNITS['mb'][:3])} AS megabytes, {Q.words('n', True)} || ' ' || {Q.decline('n', L.SIZE_UNITS['ms'][:3])} AS milliseconds FROM (SELECT CAST(p_size AS BIGINT) AS n FROM part)"
)
def size_words(spark: SparkSession, sf: str) -> DataFrame:
    sizes = table(spark, sf, "part").select(F.col("p_size").cast("long").alias("n")).distinct()
    say = lambda unit: N.size_words(F.concat(F.col("n").cast("string"), F.lit(unit)))
    return sizes.select("n", say("MB").alias("megabytes"), say(" ms").alias("milliseconds"))


@query(
    f"SELECT p_partkey, {Q.words('c // 100')} || ' точка ' || {Q.listing(L.DIGITS)}[c % 100 // 10 + 1] || ' ' || {Q.listing(L.DIGITS)}[c % 10 + 1] AS words FROM (SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS c FROM part)"
)
def float_words(spark: SparkSession, sf: str) -> DataFrame:
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    text = F.concat((cents / 100).cast("long").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    return table(spark, sf, "part").select("p_partkey", N.float_words(text).alias("words"))


@query(
    f"SELECT strftime(d, '%Y-%m-%d') AS input, {Q.listing(L.DAYS)}[day(d) + 1] || ' ' || {Q.listing(L.MONTHS)}[month(d) + 1] || ' ' || {Q.year('year(d)')} || ' года' AS words FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)"
)
def date_words(spark: SparkSession, sf: str) -> DataFrame:
    dates = _distinct(table(spark, sf, "orders"), F.date_format("o_orderdate", "yyyy-MM-dd"))
    return dates.select("input", N.date_words(F.col("input")).alias("words"))


@query(
    f"""SELECT strftime(t, '%H:%M:%S') AS input, concat_ws(' ', {Q.words('hour(t)')}, {Q.decline('hour(t)', L.HOURS)},
    CASE WHEN minute(t) > 0 OR second(t) > 0 THEN {Q.words('minute(t)')} || ' ' || {Q.decline('minute(t)', L.MINUTES)} END,
    CASE WHEN second(t) > 0 THEN {Q.words('second(t)')} || ' ' || {Q.decline('second(t)', L.SECONDS)} END) AS words
    FROM (SELECT DISTINCT date_trunc('second', CAST('2000-01-01' AS TIMESTAMP) + (CAST(ts AS TIMESTAMP) - date_trunc('day', CAST(ts AS TIMESTAMP)))) AS t FROM events)"""
)
def time_words(spark: SparkSession, sf: str) -> DataFrame:
    times = _distinct(table(spark, sf, "events"), F.date_format("ts", "HH:mm:ss"))
    return times.select("input", N.time_words(F.col("input")).alias("words"))


@query(f"SELECT p_partkey AS year, {Q.year('p_partkey')} AS words FROM part")
def year_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("year"), N.year_genitive(F.col("p_partkey")).alias("words"))


def _genitive(words: str) -> str:
    return f"list_aggregate(list_transform(string_split({words}, ' '), lambda w: coalesce({Q.mapping(L.GENITIVE)}[w], w)), 'string_agg', ' ')"


@query(
    f"SELECT a || '-' || b AS input, 'от ' || {_genitive(Q.words('a'))} || ' до ' || {_genitive(Q.words('b'))} AS words FROM (SELECT DISTINCT CAST(p_size AS BIGINT) AS a, CAST(p_size AS BIGINT) * 17 AS b FROM part)"
)
def range_words(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size").cast("long")
    texts = _distinct(table(spark, sf, "part"), F.concat(size.cast("string"), F.lit("-"), (size * 17).cast("string")))
    return texts.select("input", N.range_words(F.col("input")).alias("words"))


IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"


@query(
    f"""SELECT ip AS input, list_aggregate(list_transform(list_transform(string_split(ip, '.'), lambda o: CAST(o AS BIGINT)), lambda o: {Q.words('o')}), 'string_agg', ' точка ') AS words
    FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '{IP}')) AS ip FROM documents)"""
)
def ip_words(spark: SparkSession, sf: str) -> DataFrame:
    found = _distinct(table(spark, sf, "documents"), F.explode(F.regexp_extract_all("text", F.lit(IP), F.lit(0))))
    return found.select("input", N.ip_words(F.col("input")).alias("words"))


@query(f"SELECT DISTINCT o_orderpriority AS input, list_aggregate(list_transform(string_split(lower(o_orderpriority), ''), lambda c: coalesce({Q.mapping(L.LETTERS)}[c], c)), 'string_agg', ' ') AS words FROM orders")
def letter_spell(spark: SparkSession, sf: str) -> DataFrame:
    return _distinct(table(spark, sf, "orders"), F.col("o_orderpriority")).select("input", S.spell(F.col("input")).alias("words"))
