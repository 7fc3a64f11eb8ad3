"""Readers and cleaners of short texts as Column expressions.

Edge cases (tests/test_numbers.py): null gives null and empty texts stay empty, or have no parts; signs without a name stay as they are
where letters are spelled; letters of other scripts stay where Latin ones are transliterated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import lexicon as L
from lectern.functions.numbers import digit_words, int_words, let, lookup, number_words

TRAILING = r"[.,;:!?]*$"
#: A word of any script: letters, digits and underscores.
WORD = r"[\p{L}\p{N}_]+"
#: White space of any script, as a class of every regex dialect.
WHITE = r"\t-\r \x{85}\p{Z}"


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def split_trailing_punct(text: Column) -> tuple[Column, Column]:
    """A text without its final punctuation, and that punctuation."""
    core = F.regexp_replace(text, TRAILING, "")
    return core, F.substring(text, F.length(core) + 1, F.length(text))


def letter_name(letter: Column) -> Column:
    return lookup(L.LETTERS, F.lower(letter))


def spell(text: Column) -> Column:
    """Letters by name, other characters as they are."""
    return F.array_join(F.transform(characters(F.lower(text)), lambda c: F.coalesce(lookup(L.LETTERS, c), c)), " ")


def abbreviation(text: Column) -> Column:
    """A special reading, a reading as a word, or letter by letter."""
    return let(F.lower(text), lambda low: F.coalesce(lookup(L.SPECIAL_ABBREVIATIONS, low), lookup(L.AS_WORD, low), spell(low)))


def transliterate(word: Column) -> Column:
    """Latin letters to Cyrillic ones, longest groups first from the left."""
    groups = F.regexp_extract_all(F.lower(word), F.lit("|".join(sorted(L.TRANSLITERATION, key=lambda x: (-len(x), x))) + "|(?s:.)"), F.lit(0))
    return F.array_join(F.transform(groups, lambda g: F.coalesce(lookup(L.TRANSLITERATION, g), g)), "")


def english_word(word: Column, terms: dict[str, str] | None = None) -> Column:
    """One letter by name, a known term, an abbreviation in capitals, else transliterated."""
    known = L.TERMS | (terms or {})

    def say(w: Column) -> Column:
        return let(F.lower(w), lambda low: F.when(F.length(w) == 1, F.coalesce(lookup(L.LETTERS, low), F.lit("?"))).otherwise(F.coalesce(lookup(known, low), F.when(w.rlike("^[A-Z]{2,}$"), abbreviation(w)), lookup(L.AS_WORD, low), transliterate(low))))

    return let(word, say)


def split_camel_case(identifier: Column) -> Column:
    """Parts of an identifier: `HTMLParser2` is HTML, Parser and 2."""
    return F.regexp_extract_all(identifier, F.lit(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+"), F.lit(0))


def split_snake_case(identifier: Column) -> Column:
    return F.filter(F.split(identifier, "_"), lambda p: p != "")


def split_kebab_case(identifier: Column) -> Column:
    return F.filter(F.split(identifier, "-"), lambda p: p != "")


def code_number(digits: Column, named: list[int] = L.CODE_NUMBERS) -> Column:
    """Small and round numbers as words, others digit by digit."""
    thousand = F.when(F.lit(named is L.CODE_NUMBERS), "тысяча")
    return let(digits.try_cast("long"), lambda n: F.when(n == 1000, F.coalesce(thousand, digit_words(n.cast("string")))).when(n.isin(named), int_words(n)).otherwise(digit_words(n.cast("string"))))


def read_parts(parts: Column, terms: dict[str, str] | None = None) -> Column:
    """Parts of an identifier as words: numbers, known words, capitals by letter, else letter by letter in Cyrillic."""
    known, letters = L.CODE_TERMS | (terms or {}), L.CODE_LETTERS

    def say(part: Column) -> Column:
        spelled = F.array_join(F.transform(characters(F.lower(part)), lambda c: F.coalesce(lookup(letters, c), c)), "")
        return F.when(part.rlike(r"^\d+$"), code_number(part)).otherwise(F.coalesce(lookup(known, F.lower(part)), F.when(part.rlike("^[A-Z]{2,}$"), spell(part)), spelled))

    return F.array_join(F.transform(parts, say), " ")


def strip_white(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A[{WHITE}]+|(?=[{WHITE}])(?<![{WHITE}])[{WHITE}]+\z", "")


def sanitize(text: Column) -> Column:
    """Line breaks with the white space around them to one space, runs of spaces to one, none at the ends; tabs within a line stay."""
    blank = r"\t\x0B-\r \x{85}\p{Z}"
    joined = F.regexp_replace(text, rf"(?=[\n{blank}])(?<![{blank}])[{blank}]*+\n[{WHITE}]*+", " ")
    return strip_white(F.regexp_replace(joined, " {2,}", " "))


def clean_carets(text: Column) -> Column:
    """Caret marks that skip a stress: one space before, none after, runs as one, none at the end."""
    spaced = strip_white(F.regexp_replace(F.replace(text, F.lit("^"), F.lit(" ^")), rf"[{WHITE}]+", " "))
    return strip_white(F.regexp_replace(strip_white(F.regexp_replace(F.replace(spaced, F.lit("^ "), F.lit("^")), r"\^+", "^")), r"\^\z", ""))


#: Signs that a voice knows, besides carets.
VOICE_SYMBOLS = "!+,-.:;?абвгдежзийклмнопрстуфхцчшщъыьэюяё–… "


def voice_input(text: Column, symbols: str = VOICE_SYMBOLS) -> Column:
    """struct<sentence, clean_sentence, has_text>: lower-cased, known signs alone, carets cleaned; then Cyrillic letters alone."""
    kept = "".join("\\" + c if c in "\\^[]-&" else c for c in symbols)
    dashed = F.translate(F.lower(text), "—\u2011", "–-")
    sentence = clean_carets(F.regexp_replace(dashed, rf"[^{kept}\^]", ""))

    def parts(x: Column) -> Column:
        clean = F.regexp_replace(x, r"[^а-я\- ]", "")
        return F.struct(x.alias("sentence"), clean.alias("clean_sentence"), F.regexp_replace(clean, " ", "").rlike(".").alias("has_text"))

    return let(sentence, parts)


def symbol_table(symbols: str, first: int, last: int, text: Column) -> Column:
    """struct<ids, chars> of a sentence between a first and a last id, with the character that each id comes from."""
    found = F.filter(F.transform(characters(text), lambda c: F.struct(F.instr(F.lit(symbols), c).alias("id"), c.alias("ch"))), lambda x: x["id"] > 0)
    ids = F.concat(F.array(F.lit(first)), F.transform(found, lambda x: x["id"]), F.array(F.lit(last)))
    return F.struct(ids.alias("ids"), F.concat(F.array(F.lit("~")), F.transform(found, lambda x: x["ch"]), F.array(F.lit("|"))).alias("chars"))


def directives(text: Column) -> Column:
    """array<struct<start, mode>> of the directives that say how the code after them is read."""
    pattern = r"<!--\s*[a-z]+-code:\s*(?:full|brief)\s*-->"
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,mode:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        return F.struct((start + F.length(x["found"])).alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), F.when(x["found"].contains("brief"), "brief").otherwise("full").alias("mode")))).alias("out"))

    pairs = F.filter(F.arrays_zip(found.alias("found"), gaps.alias("gap")), lambda x: x["found"].isNotNull())
    return F.aggregate(pairs, zero, step)["out"]


def strip_markup(text: Column) -> Column:
    """Without `[[...]]`, also where it is not closed, and `<tag ...>`."""
    return F.regexp_replace(text, r"(?s)\[\[.*?(?:\]\]|\z)|<[A-Za-z/][^>]*>", "")


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def letter_key(text: Column) -> Column:
    return F.translate(F.lower(text), "ё", "е")


def preview(text: Column, size: int = 60) -> Column:
    return F.concat(F.substring(text, 1, size), F.when(F.length(text) > size, "…").otherwise(""))


def char_ngrams(word: Column) -> Column:
    """Character n-grams of `<word>`, of every length."""
    padded = F.concat(F.lit("<"), word, F.lit(">"))
    ngrams = lambda p: F.flatten(F.transform(F.sequence(F.lit(1), F.length(p)), lambda n: F.transform(F.sequence(F.lit(1), F.length(p) - n + 1), lambda i: F.substring(p, i, n))))
    return let(padded, ngrams)


def symbol_sequence(text: Column, symbols: str, first: int, last: int) -> Column:
    """Ids of known symbols between a first and a last id; others are dropped."""
    found = F.filter(F.transform(characters(F.lower(text)), lambda c: F.instr(F.lit(symbols), c)), lambda k: k > 0)
    return F.concat(F.array(F.lit(first)), found, F.array(F.lit(last)))


def code_block_words(code: Column, terms: dict[str, str] | None = None) -> Column:
    """Names, numbers, strings and signs of a block of code in turn; signs without a name are left out."""
    greek = "".join(x for x in L.SYMBOLS if x.isalpha())
    tokens = F.regexp_extract_all(code, F.lit(rf"""[{greek}{L.ARROWS}{L.BLOCK_MATH}]|[a-zA-Z_][a-zA-Z0-9_]*|\d+|'[^']*'|"[^"]*"|[()\[\]{{}}]|[+\-*/=<>!&|]{{1,3}}|[.,;:]"""), F.lit(0))
    quoted = lambda t: F.substring(t, F.lit(2), F.length(t) - 2)

    def say(t: Column) -> Column:
        parts = F.when(t.rlike("^['\"]"), split_snake_case(F.lower(quoted(t)))).when(t.contains("_"), split_snake_case(t)).when(t.rlike("^.+[A-Z]"), split_camel_case(t)).otherwise(F.array(F.lower(t)))
        return F.when(t.rlike("^[0-9]"), code_number(t, L.BLOCK_NUMBERS)).when(t.rlike("^(?:[A-Za-z_]|['\"].)"), read_parts(parts, terms)).otherwise(F.coalesce(lookup(L.SYMBOLS, t), lookup(L.SIGNS, t), F.lit("")))

    return F.array_join(F.filter(F.transform(tokens, lambda t: let(t, say)), lambda x: x != ""), " ")


def code_words(text: Column, terms: dict[str, str] | None = None) -> Column:
    """White-space separated words of inline code, each by its parts."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: read_parts(split_snake_case(w), terms)), " ")


# Fixed values
IDEOGRAPHS = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}"
PUNCTUATION = r"!-/:-@\[-`{-~\p{P}"
# End of fixed values


def basic_tokens(text: Column, never_split: tuple[str, ...] = ()) -> Column:
    """Words between white space, with signs and ideographs on their own; control characters are dropped, some words are never split."""
    clean = F.regexp_replace(text, r"[\x{FFFD}[\p{C}&&[^\t\n\r]]]", "")
    words = F.regexp_extract_all(F.regexp_replace(clean, f"([{IDEOGRAPHS}])", " $1 "), F.lit(f"[^{WHITE}]+"), F.lit(0))
    cut = lambda w: F.regexp_extract_all(w, F.lit(f"[{PUNCTUATION}]|[^{PUNCTUATION}]+"), F.lit(0))
    return F.flatten(F.transform(words, lambda w: F.when(w.isin(*never_split), F.array(w)).otherwise(cut(w)) if never_split else cut(w)))
