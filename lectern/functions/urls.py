"""Readers of URLs, addresses and paths as Column expressions.

Edge cases (tests/test_urls.py): null gives null; empty texts read as empty; percent signs that start no byte, and bytes that are no
UTF-8, are read as percent; scripts other than Latin and Cyrillic part words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import lexicon as L
from lectern.functions.numbers import let, lookup, number_words
from lectern.functions.strings import transliterate

_SIGNS = "".join("\\" + x for x in L.DECODED)
Terms = dict[str, str] | None


def percent_decode(text: Column, plus_as_space: bool = False) -> Column:
    """Each run of %XX as one UTF-8 text; a run that is none stays, in lower case, as does a percent sign without two digits."""
    run = lambda x: let(F.unhex(F.replace(x, F.lit("%"), F.lit(""))).cast("string"), lambda b: F.when(F.is_valid_utf8(b), b).otherwise(F.lower(x)))
    plain = (lambda x: F.replace(x, F.lit("+"), F.lit(" "))) if plus_as_space else (lambda x: x)
    parts = F.regexp_extract_all(text, F.lit("(?:%[0-9A-Fa-f]{2})+|[^%]+|%"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^%."), run(x)).otherwise(plain(x))), "")


def _ascii_word(word: Column, terms: Terms) -> Column:
    return let(F.lower(word), lambda low: F.when(low.rlike("[a-z]"), F.coalesce(lookup(L.TERMS | (terms or {}), low), transliterate(low))).otherwise(word))


def word_reading(word: Column, terms: Terms = None) -> Column:
    """A known term or a transliteration; Cyrillic stays, other scripts part words."""
    pieces = F.regexp_extract_all(F.translate(word, "_", " "), F.lit(r"[\p{IsCyrillic}A-Za-z0-9\s]+"), F.lit(0))
    mixed = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"\p{IsCyrillic}"), p).otherwise(_ascii_word(p, terms))), " ")
    return F.when(F.octet_length(word) == F.char_length(word), _ascii_word(word, terms)).otherwise(mixed)


def _spoken(words: Column) -> Column:
    return F.array_join(F.filter(words, lambda x: x != ""), " ")


def runs_reading(part: Column, terms: Terms = None) -> Column:
    """Runs of digits as numbers, the others as words."""
    runs = F.regexp_extract_all(part, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return _spoken(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), number_words(r)).otherwise(word_reading(r, terms))))


def _segment(part: Column, terms: Terms) -> Column:
    return _spoken(F.transform(F.split(part, "[-_]"), lambda x: runs_reading(x, terms)))


def component_reading(text: Column, terms: Terms = None) -> Column:
    """Decoded text: marks by name, dotted parts joined by a dot's name, digits as numbers."""
    tokens = F.regexp_extract_all(text, F.lit(f"[%+{_SIGNS}]|[^%+{_SIGNS}\\s\\p{{Cntrl}}]+"), F.lit(0))
    chunk = lambda c: F.array_join(F.transform(F.split(c, r"\."), lambda x: _segment(x, terms)), " точка ")
    return _spoken(F.transform(tokens, lambda t: F.coalesce(lookup({"%": "процент", "+": "плюс"} | L.DECODED, t), chunk(t))))


def _labels(host: Column, terms: Terms, decode: bool) -> Column:
    labels = F.split(host, r"\.")

    def say(x: Column, i: Column) -> Column:
        top = F.when(i == F.size(labels) - 1, lookup(L.TLDS, F.lower(x)))
        plain = F.coalesce(top, runs_reading(x, terms))
        return F.when(x.rlike("[%+]"), component_reading(percent_decode(x), terms)).otherwise(plain) if decode else plain

    return F.array_join(F.transform(labels, say), " точка ")


def host_and_tail(rest: Column, terms: Terms = None) -> Column:
    """host[:port][/path][?query][#fragment] as words; parts of the query without an equals sign are left out."""

    def parts(x: Column) -> Column:
        cut = lambda sign: F.substring_index(x, sign, 1)
        authority = F.when(x.contains("/"), cut("/")).when(x.contains("?"), cut("?")).otherwise(cut("#"))
        return let(F.struct(authority.alias("authority"), F.substring(x, F.length(authority) + 1, F.length(x)).alias("tail")), say)

    def say(x: Column) -> Column:
        port, tail = F.regexp_extract(x["authority"], ":([0-9]+)$", 1), x["tail"]
        path = F.when(tail.contains("?"), F.substring_index(tail, "?", 1)).otherwise(F.substring_index(tail, "#", 1))
        after = F.substring(tail, F.length(path) + 1 + F.when(tail.contains("?"), 1).otherwise(0), F.length(tail))
        query, fragment = F.substring_index(after, "#", 1), F.regexp_extract(after, "(?s)^[^#]*#(.*)$", 1)
        component = lambda c, plus=False: component_reading(percent_decode(c, plus), terms)
        steps = F.filter(F.transform(F.split(path, "/"), lambda s: component(s)), lambda s: s != "")
        pairs = F.filter(F.split(query, "&"), lambda p: p.contains("="))
        asked = F.transform(pairs, lambda p: F.concat(component(F.substring_index(p, "=", 1), True), F.lit(" равно "), component(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1), True)))
        return F.concat_ws(
            " ", _labels(F.regexp_replace(x["authority"], ":[0-9]+$", ""), terms, True),
            F.when(port != "", F.concat(F.lit("двоеточие "), number_words(port))),
            F.when(F.size(steps) > 0, F.array_join(F.transform(steps, lambda s: F.concat(F.lit("слэш "), s)), " ")),
            F.when(query != "", F.concat_ws(" ", F.lit("вопросительный знак"), asked)),
            let(component(fragment), lambda f: F.when(f != "", F.concat(F.lit("решётка "), f))),
        )

    return let(rest, parts)


def url_reading(url: Column, terms: Terms = None) -> Column:
    scheme = F.substring_index(url, "://", 1)
    words = F.concat_ws(" ", F.coalesce(lookup(L.PROTOCOLS, F.lower(scheme)), scheme), F.lit("двоеточие слэш слэш"), host_and_tail(F.regexp_extract(url, "(?s)^.*?://(.*)$", 1), terms))
    return F.when(url.contains("://"), words).otherwise(url)


def email_reading(email: Column, terms: Terms = None) -> Column:
    marks = {".": "точка", "_": "андерскор", "-": "дефис", "+": "плюс", "%": "процент"} | L.DECODED
    signs = "".join("\\" + x for x in marks)
    tokens = F.regexp_extract_all(percent_decode(F.regexp_extract(email, "(?s)^(.*)@", 1)), F.lit(f"[{signs}]|[0-9]+|[^{signs}0-9\\s\\p{{Cntrl}}]+"), F.lit(0))
    local = _spoken(F.transform(tokens, lambda t: F.coalesce(lookup(marks, t), F.when(t.rlike("^[0-9]"), number_words(t)), word_reading(t, terms))))
    domain = _labels(F.substring_index(email, "@", -1), terms, False)
    return F.when(email.contains("@"), F.concat(local, F.lit(" собака "), domain)).otherwise(email)


def _file_name(part: Column, terms: Terms) -> Column:
    words = F.transform(F.split(part, "-"), lambda p: F.array_join(F.transform(F.filter(F.split(p, "_"), lambda s: s != ""), lambda s: runs_reading(s, terms)), " "))
    return F.array_join(F.filter(words, lambda x: x != ""), " дефис ")


def path_reading(path: Column, terms: Terms = None) -> Column:
    """Segments and separators of a path: home, dots, drives, hidden files and names with several dots."""
    named = lambda x: F.array_join(F.transform(F.split(x, r"\."), lambda p: _file_name(p, terms)), " точка ")

    def hidden(x: Column) -> Column:
        rest = F.substring(x, 2, 1 << 30)
        extension = F.substring_index(rest, ".", -1)
        name = F.substring(rest, 1, F.length(rest) - F.length(extension) - 1)
        return F.when(rest.contains("."), F.concat_ws(" ", F.lit("точка"), _file_name(name, terms), F.lit("точка"), runs_reading(extension, terms))).otherwise(F.concat(F.lit("точка "), _file_name(rest, terms)))

    def segment(x: Column) -> Column:
        drive = F.lower(F.substring(x, 1, 1))
        special = F.when(x == "~", "тильда").when(x == ".", "точка").when(x == "..", "точка точка")
        special = special.when(x.rlike("^[A-Za-z]:$"), F.concat(F.coalesce(lookup(L.DRIVES, drive), drive), F.lit(" двоеточие")))
        return F.coalesce(special, F.when(F.startswith(x, F.lit(".")), hidden(x)), named(x))

    back = path.contains("\\")
    segments = F.when(back, F.split(path, r"\\")).otherwise(F.split(path, "/"))
    said = F.transform(segments, lambda x, i: F.concat_ws(" ", F.when(i > 0, F.when(back, "бэкслэш").otherwise("слэш")), F.when(x != "", segment(x))))
    return F.array_join(F.filter(said, lambda x: x != ""), " ")


_URL = r"(?s)^(([A-Za-z][A-Za-z0-9+.-]*):)?(//([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?$"


def without_dots(path: Column) -> Column:
    """A path with its `.` and `..` segments worked off."""

    def step(kept: Column, part: Column) -> Column:
        return F.when(part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    parts = F.split(path, "/")
    whole = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.get(parts, 0)), step)
    return F.array_join(F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(whole, F.array(F.lit("")))).otherwise(whole), "/")


def resolve_url(url: Column, base: Column, browser: bool = False) -> Column:
    """A possibly relative URL against that of its document, by the rules of references of RFC 3986; unchanged without a base that has a scheme.

    As browsers write it, a scheme and host are in lower case, and an empty path behind a host is `/`.
    """
    of = lambda x, k: F.regexp_extract(x, _URL, k)
    path, query, base_path = of(url, 5), of(url, 6), of(base, 5)
    folder = F.regexp_extract(base_path, r"(?s)^(.*/)?", 1)
    merged = F.when((of(base, 3) != "") & (base_path == ""), F.concat(F.lit("/"), path)).otherwise(F.concat(folder, path))
    own = (of(url, 1) != "") | (of(url, 3) != "")
    found = F.when(own, without_dots(path)).when(path == "", base_path).when(path.startswith("/"), without_dots(path)).otherwise(without_dots(merged))
    asks = F.when(own | (path != "") | (query != ""), query).otherwise(of(base, 6))
    scheme, host = F.when(of(url, 1) != "", of(url, 1)).otherwise(of(base, 1)), F.when(own, of(url, 3)).otherwise(of(base, 3))
    if browser:
        scheme, host = F.lower(scheme), F.concat(F.regexp_extract(host, r"(?s)^(//(?:.*@)?)?", 1), F.lower(F.regexp_extract(host, r"(?s)^(?://(?:.*@)?)?(.*)$", 1)))
        found = F.when((found == "") & (host != ""), "/").otherwise(found)
    return F.when(base.isNull() | (of(base, 1) == ""), url).otherwise(F.concat(scheme, host, found, asks, of(url, 7)))
