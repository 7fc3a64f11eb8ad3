"""Readers of numbers, dates, times and sizes as Column expressions.

Edge cases (tests/test_numbers.py): null gives null (a null year no words); what is not of the form that is read, numbers beyond 18
digits, and dates and times that don't exist stay as they are; empty texts stay empty; signs that are no digits are read as a question
mark where digits are read one by one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import lexicon as L


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, which keeps the generated code small."""
    return F.get(F.transform(F.array(value), body), 0)


def pick(words: list[str], index: Column) -> Column:
    """words[index], null for an empty word; one literal, which the optimizer splits once."""
    return F.nullif(F.get(F.split(F.lit("|".join(words)), r"\|"), index.cast("int")), F.lit(""))


def lookup(table: dict[str, str], key: Column) -> Column:
    pairs = "\x01".join(f"{k}\x02{v}" for k, v in table.items())
    return F.try_element_at(F.str_to_map(F.lit(pairs), F.lit("\x01"), F.lit("\x02")), key)


def _say_triad(n: int, feminine: bool = False) -> str:
    low = n % 100
    ones = L.ONES_FEMININE if feminine else L.ONES
    return " ".join(x for x in (L.HUNDREDS[n // 100], L.TENS[low // 10] if low >= 20 else "", ones[low if low < 20 else low % 10]) if x)


def _form(n: int) -> int:
    return 2 if 11 <= n % 100 <= 19 else 0 if n % 10 == 1 else 1 if 2 <= n % 10 <= 4 else 2


def _counted(forms: tuple[str, str, str], feminine: bool) -> list[str]:
    return ["", *(f"{_say_triad(n, feminine)} {forms[_form(n)]}" for n in range(1, 1000))]


#: Words of 0 to 999, of either gender, and of so many thousands, millions and billions; which form of a noun goes with 0 to 99.
_MASCULINE, _FEMININE = [_say_triad(n) for n in range(1000)], [_say_triad(n, True) for n in range(1000)]
_THOUSANDS, _MILLIONS, _BILLIONS = _counted(L.THOUSAND, True), _counted(L.MILLION, False), _counted(L.BILLION, False)
_FORMS = "".join(str(_form(n)) for n in range(100))


def declension(n: Column, forms: tuple[str, str, str]) -> Column:
    return F.get(F.split(F.lit("|".join(forms)), r"\|"), _which(n))


def _which(n: Column) -> Column:
    return F.substring(F.lit(_FORMS), (F.abs(n) % 100).cast("int") + 1, F.lit(1)).cast("int")


def _positive(n: Column, feminine: bool) -> Column:
    below = lambda n, last: [pick(_MILLIONS, (n / 10**6).cast("int") % 1000), pick(_THOUSANDS, (n / 1000).cast("int") % 1000), pick(last, n % 1000)]
    low, high = n % 10**9, ((n - n % 10**9) / 10**9).cast("long")
    many = F.concat_ws(" ", pick(_BILLIONS, high / 10**9), *below(high % 10**9, _MASCULINE), declension(high, L.BILLION))
    top = F.when(high > 999, many).otherwise(pick(_BILLIONS, high))
    return F.concat_ws(" ", F.when(n >= 10**9, top), *below(low, _FEMININE if feminine else _MASCULINE))


def int_words(n: Column, feminine: bool = False) -> Column:
    """Cardinal of a whole number; there is no word above billions, which are counted themselves."""
    def say(n: Column) -> Column:
        words = F.when(n == 0, F.lit("ноль")).otherwise(_positive(F.abs(n), feminine))
        return F.when(n < 0, F.concat(F.lit("минус "), words)).when(n.isNotNull(), words)

    return let(n.cast("long"), say)


def number_words(text: Column) -> Column:
    """A text that is a whole number as words, others unchanged."""
    return F.coalesce(int_words(F.trim(text).try_cast("long")), text)


def digit_words(text: Column) -> Column:
    digits = F.filter(F.split(text, ""), lambda c: c != "")
    return F.array_join(F.transform(digits, lambda c: F.coalesce(pick(L.DIGITS, c.try_cast("int")), F.lit("?"))), " ")


def float_words(text: Column) -> Column:
    dotted = F.replace(text, F.lit(","), F.lit("."))
    whole, rest = F.substring_index(dotted, ".", 1), F.regexp_extract(dotted, r"^[^.]*\.(.*)$", 1)
    return F.when(F.contains(dotted, F.lit(".")), F.concat(number_words(whole), F.lit(" точка "), digit_words(rest))).otherwise(number_words(dotted))


def percent_words(text: Column) -> Column:
    number = F.trim(F.regexp_replace(text, "%+$", ""))
    whole = lambda number: let(number.try_cast("long"), lambda n: F.concat(int_words(n), F.lit(" "), declension(n, L.PERCENT)))
    return let(number, lambda x: F.when(x.rlike("[.,]"), F.concat(float_words(x), F.lit(" процентов"))).otherwise(F.coalesce(whole(x), text)))


def size_words(text: Column) -> Column:
    number, unit = F.regexp_extract(F.trim(text), r"^([\d.,]+)\s*([a-zA-Zа-яА-Я]+)$", 1), F.lower(F.regexp_extract(F.trim(text), r"^([\d.,]+)\s*([a-zA-Zа-яА-Я]+)$", 2))
    return let(F.struct(number.alias("number"), unit.alias("unit"), number.try_cast("long").alias("whole")), lambda x: _size_words(x["number"], x["unit"], x["whole"], text))


def _size_words(number: Column, unit: Column, whole: Column, text: Column) -> Column:
    part = lambda k: lookup({u: x[k] for u, x in L.SIZE_UNITS.items()}, unit)
    feminine = unit.isin([u for u, x in L.SIZE_UNITS.items() if x[3]])
    form = F.get(F.array(part(0), part(1), part(2)), _which(whole))
    words = F.when(feminine, int_words(whole, True)).otherwise(int_words(whole))
    found = F.when(number.rlike("[.,]"), F.concat(float_words(number), F.lit(" "), part(2))).otherwise(F.concat(words, F.lit(" "), form))
    return F.coalesce(found, text)


def _say_ordinal(n: int) -> str:
    if not n:
        return ""
    if n < 20:
        return L.ORDINAL_GENITIVE[n]
    return f"{L.TENS[n // 10]} {L.ORDINAL_GENITIVE[n % 10]}" if n % 10 else f"{L.TENS_ORDINAL[n // 10]}ого"


_ORDINALS = [_say_ordinal(n) for n in range(100)]


def year_genitive(year: Column) -> Column:
    """Ordinal of a year in the genitive; round thousands are glued to their cardinal."""
    return let(year.cast("long"), _year_genitive)


def _year_genitive(year: Column) -> Column:
    thousands, low = F.floor(year / 1000), year % 1000
    hundreds, below = F.floor(low / 100), year % 100
    head = F.concat_ws(" ", int_words(thousands, True), declension(thousands, L.THOUSAND))
    full = F.concat_ws(" ", F.when(thousands > 0, head), pick(L.HUNDREDS, hundreds), pick(_ORDINALS, below))
    return (
        F.when(year == 2000, F.lit("двухтысячного"))
        .when(low == 0, F.concat(int_words(thousands, True), F.lit("тысячного")))
        .when(below == 0, F.concat(head, F.lit(" "), pick(L.HUNDREDS_ORDINAL, hundreds), F.lit("ого")))
        .otherwise(full)
    )


def genitive_words(n: Column) -> Column:
    words = F.array_join(F.transform(F.split(int_words(n), " "), lambda w: F.coalesce(lookup(L.GENITIVE, w), w)), " ")
    return F.when(n.between(1000, 9999), year_genitive(n)).otherwise(words)


def range_words(text: Column) -> Column:
    """`10-20` as from and to, in the genitive; other texts unchanged."""
    ends = F.split(text, "[-–—]", 2)
    end = lambda k: let(F.trim(F.get(ends, k)).try_cast("long"), genitive_words)
    return F.coalesce(F.concat(F.lit("от "), end(0), F.lit(" до "), end(1)), text)


def date_words(text: Column) -> Column:
    """`YYYY-MM-DD`, `DD.MM.YYYY` and the like; dates out of range unchanged."""
    return let(F.split(text, "[-/.]"), lambda parts: _date_words(parts, text))


def _date_words(parts: Column, text: Column) -> Column:
    first = F.octet_length(F.get(parts, 0)) == 4
    year = F.when(first, F.get(parts, 0)).otherwise(F.get(parts, 2)).try_cast("long")
    month, day = F.get(parts, 1).try_cast("int"), F.when(first, F.get(parts, 2)).otherwise(F.get(parts, 0)).try_cast("int")
    def say(x: Column) -> Column:
        ok = (F.size(parts) == 3) & (x["y"] > 0) & x["m"].between(1, 12) & x["d"].between(1, 31)
        return F.when(ok, F.concat_ws(" ", pick(L.DAYS, x["d"]), pick(L.MONTHS, x["m"]), year_genitive(x["y"]), F.lit("года"))).otherwise(text)

    return let(F.struct(year.alias("y"), month.alias("m"), day.alias("d")), say)


def time_words(text: Column) -> Column:
    """`HH:MM[:SS]`; all numerals are masculine. Times out of range unchanged."""
    return let(F.split(text, ":"), lambda parts: _time_words(parts, text))


def _time_words(parts: Column, text: Column) -> Column:
    hour, minute = F.get(parts, 0).try_cast("long"), F.get(parts, 1).try_cast("long")
    second = F.when(F.size(parts) > 2, F.get(parts, 2).try_cast("long")).otherwise(F.lit(0))
    say = lambda n, forms: F.concat_ws(" ", int_words(n), declension(n, forms))
    words = F.concat_ws(" ", say(hour, L.HOURS), F.when((minute > 0) | (second > 0), say(minute, L.MINUTES)), F.when(second > 0, say(second, L.SECONDS)))
    return F.when(hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59), words).otherwise(text)


def ip_words(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, r"\."), number_words), " точка ")


def version_words(text: Column) -> Column:
    """Numbers joined by a dot's name, with suffix words; a leading v is silent."""
    def say(token: Column) -> Column:
        name, number = F.lower(F.regexp_extract(token, r"^([a-zA-Z]+)(\d*)$", 1)), F.regexp_extract(token, r"^([a-zA-Z]+)(\d*)$", 2)
        suffix = lookup(L.VERSION_SUFFIXES, name)
        return F.when(token == ".", F.lit("точка")).when(suffix.isNotNull(), F.concat_ws(" ", suffix, F.when(number != "", number_words(number)))).otherwise(number_words(token))

    tokens = F.regexp_extract_all(F.regexp_replace(text, "^[vV]+", ""), F.lit(r"[^.\-]+|\."), 0)
    return F.array_join(F.transform(tokens, say), " ")
