"""Readers of numbers and short texts, by literal readings; numerals of times are masculine, as the readings to match have them."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import numbers as N
from lectern.functions import strings as S

READ = [
    (N.number_words, {"0": "ноль", "007": "семь", "42": "сорок два", "99999999999999999999": "99999999999999999999", "x": "x"}),
    (N.digit_words, {"123": "один два три", "x": "?"}),
    (N.float_words, {"3.14": "три точка один четыре", "0.5": "ноль точка пять", "10.0": "десять точка ноль", "1,5": "один точка пять", "x": "x"}),
    (N.percent_words, {"50%": "пятьдесят процентов", "1%": "один процент", "22%": "двадцать два процента", "2.5%": "два точка пять процентов", "x": "x"}),
    (N.size_words, {"100MB": "сто мегабайт", "5GB": "пять гигабайт", "1 KB": "один килобайт", "2TB": "два терабайта", "1.5 MB": "один точка пять мегабайт", "x": "x"}),
    (N.range_words, {"10-20": "от десяти до двадцати", "1-5": "от одного до пяти", "x": "x"}),
    (N.date_words, {"12.05.2024": "двенадцатое мая две тысячи двадцать четвёртого года", "2024-01-01": "первое января две тысячи двадцать четвёртого года", "31.13.2020": "31.13.2020", "x": "x"}),
    (N.time_words, {"14:30": "четырнадцать часов тридцать минут", "00:00": "ноль часов", "09:05": "девять часов пять минут", "21:01": "двадцать один час один минута", "25:61": "25:61", "x": "x"}),
    (N.ip_words, {"192.168.0.1": "сто девяносто два точка сто шестьдесят восемь точка ноль точка один", "x": "x"}),
    (N.version_words, {"1.2.3": "один точка два точка три", "v2.0": "два точка ноль", "10.0-beta": "десять точка ноль бета", "x": "x"}),
    (S.spell, {"API": "эй пи ай", "a1": "эй 1"}),
    (S.abbreviation, {"JSON": "джейсон", "HTTP": "эйч ти ти пи", "ios": "ай оу эс", "x": "икс"}),
    (S.transliterate, {"hello": "хелло", "shell": "шелл"}),
    (S.english_word, {"A": "эй", "API": "эй пи ай", "docker": "докер", "XYZ": "икс вай зет"}),
    (S.sanitize, {"  a \n b  c\t d ": "a b c\t d", "a\n\n\nb": "a b", "a  b": "a b", " x": "x"}),
    (S.clean_carets, {"a ^ b^^c ^": "a ^b ^c"}),
    (S.escape_html, {'<a href="x">&': "&lt;a href=&quot;x&quot;&gt;&amp;"}),
    (S.letter_key, {"Ёж": "еж"}),
    (S.preview, {"a" * 61: "a" * 60 + "…", "a" * 60: "a" * 60}),
]


@pytest.mark.parametrize(("read", "cases"), READ, ids=lambda x: getattr(x, "__name__", ""))
def test_readings(spark, read, cases):
    texts = [*cases, "", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in texts], "x string").coalesce(1).select(read(F.col("x"))).collect()]
    assert got == [*cases.values(), "", None]


def test_numbers_with_their_genders(spark):
    cases = {
        0: "ноль", 2: "два", 11: "одиннадцать", 21: "двадцать один", 100: "сто", 342: "триста сорок два", 1000: "одна тысяча", 2001: "две тысячи один", 5000: "пять тысяч", 21000: "двадцать одна тысяча",
        1000000: "один миллион", 1234567: "один миллион двести тридцать четыре тысячи пятьсот шестьдесят семь", 10**9: "один миллиард", -7: "минус семь", None: None,
    }
    rows = spark.createDataFrame([(x,) for x in cases], "x long").coalesce(1).select(N.int_words(F.col("x")), N.int_words(F.col("x"), True)).collect()
    assert [r[0] for r in rows] == list(cases.values())
    assert [rows[list(cases).index(k)][1] for k in (2, 21)] == ["две", "двадцать одна"]


def test_years(spark):
    cases = {2024: "две тысячи двадцать четвёртого", 2000: "двухтысячного", 1999: "одна тысяча девятьсот девяносто девятого", 1900: "одна тысяча девятисотого"}
    assert [r[0] for r in spark.createDataFrame([(x,) for x in cases], "x long").coalesce(1).select(N.year_genitive(F.col("x"))).collect()] == list(cases.values())


def test_parts_of_identifiers(spark):
    df = spark.createDataFrame([("getUserData", "user_id", "a-b"), ("HTMLParser2", "_a__b", ""), (None, None, None)], "a string, b string, c string").coalesce(1)
    got = df.select(S.split_camel_case(F.col("a")), S.split_snake_case(F.col("b")), S.split_kebab_case(F.col("c"))).collect()
    assert [tuple(r) for r in got] == [(["get", "User", "Data"], ["user", "id"], ["a", "b"]), (["HTML", "Parser", "2"], ["a", "b"], []), (None, None, None)]
