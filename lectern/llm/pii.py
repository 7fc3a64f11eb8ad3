"""Personal data: patterns propose spans, checksums confirm them, context words move their score.

Base kinds, found leftmost and without overlap within a kind: email; ip, with parts of at most 255; card, 14 to 19 digits that pass
Luhn; phone, `+` and 10 to 15 digits. A proposal that fails its check is dropped. The method adds kinds. iban: a country code and check
digits whose rearranged number is 1 modulo 97. ssn: nine digits as 3-2-4, none of the groups that are never given out. secret: a run of
20 signs or more of keys and tokens, with letters, digits and many different signs. Every span has a score: the kind's prior, raised by
RAISE for each different context word of that kind that begins or ends within CONTEXT characters on either side; words are whole, from
one sign that is no letter to the next (`api_key` holds "key", "monkey" does not). Base spans are kept whatever their score; an added
kind needs THRESHOLD, which a valid iban reaches by itself, while an ssn or a secret needs a word beside it.

Patterns run in time linear in the text: a proposal starts at a sign every match must hold, or at the start of a run.

Edge cases (tests/llm/test_pii.py): null and empty texts have no spans; positions are code points; very long runs of digits or of
address characters are read once; repeated rows and null ids keep one result each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]
CONTEXT, THRESHOLD, RAISE = 40, 0.6, 0.25
# What a kind is worth without context, and the words near a span that speak for it (en, fr, de, es).
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "secret": 0.4}
WORDS = {
    "email": ("mail", "contact", "kontakt", "correo", "courriel", "write"),
    "ip": ("ip", "address", "server", "host", "adresse", "servidor"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "call", "tel", "mobile", "telefon", "téléphone", "teléfono", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta", "transfer"),
    "ssn": ("ssn", "social", "tax id", "taxpayer"),
    "secret": ("token", "key", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential", "schlüssel", "passwort", "clave", "contraseña", "clé"),
}
# End of fixed values.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{2,4}){2,8}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}")
_LETTER = re.compile("[A-Za-z]")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")
_LETTERS = r"[^\W\d_]"
_CONTEXT = {kind: re.compile(f"(?<!{_LETTERS})(?:{'|'.join(words)})(?!{_LETTERS})") for kind, words in WORDS.items()}
#: Letters of a context word that may lie outside CONTEXT.
_LONGEST = max(len(w) for words in WORDS.values() for w in words)


def luhn(digits: str) -> bool:
    total = 0
    for i, x in enumerate(reversed(digits)):
        n = ord(x) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod_97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(x, 36)) for x in moved)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            done = domain.end()
            yield start, done
        else:
            done = at + 1
        at = text.find("@", done)


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that passed their checks."""
    if "@" in text:
        for a, z in emails(text):
            yield "email", a, z
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text) if "." in text else ():
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() and 14 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for m in _IBAN.finditer(text):
        if 15 <= len(iban := m[0].replace(" ", "")) <= 34 and mod_97(iban):
            yield "iban", m.start(), m.end()
    for m in _SSN.finditer(text) if "-" in text else ():
        yield "ssn", m.start(), m.end()
    for m in _SECRET.finditer(text):
        if len(set(m[0])) >= 8 and _DIGIT.search(m[0]) and _LETTER.search(m[0]):
            yield "secret", m.start(), m.end()


def near_words(text: str, kind: str, start: int, stop: int) -> set[str]:
    """Context words of a kind that reach into the CONTEXT characters before or after a span; the span itself ends a word."""
    low, high, found = max(0, start - CONTEXT), stop + CONTEXT, _CONTEXT[kind].finditer
    before, after = text[max(0, low - _LONGEST - 1) : start].lower(), text[stop : high + _LONGEST + 1].lower()
    edge = start - low
    return {m[0] for m in found(before) if len(before) - m.end() < edge} | {m[0] for m in found(after) if m.start() < CONTEXT}


def scored(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind as listed."""
    out = []
    for kind, a, z in proposals(text):
        score = min(1.0, PRIOR[kind] + RAISE * len(near_words(text, kind, a, z)))
        if kind in BASE or score >= THRESHOLD:
            out.append((kind, a, z, score))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def masked(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span, or union of overlapping spans, replaced by its first kind in brackets."""
    parts, done = [], 0
    for kind, a, z, _ in spans:
        if a >= done:
            parts += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, z)
    return "".join(parts) + text[done:]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def find_spans(text: Column) -> Column:
    """array<struct<kind, start, end, score>> of a text column."""
    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("kind", "start", "end", "score"), x)) for x in scored(t or "")] for t in texts], dtype=object)

    return spans(text)


def mask_spans(text: Column) -> Column:
    """The text with personal data replaced; null stays null."""
    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return pd.Series([masked(t, found) if t and (found := scored(t)) else t for t in texts], dtype=object)

    return mask(text)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) for every row of docs."""
    return docs.select(F.col(id_col).alias("id"), find_spans(F.col(text_col)).alias("spans"))
