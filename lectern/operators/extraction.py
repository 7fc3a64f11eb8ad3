"""Ordered scans over one text, as Arrow-batched functions: HTML text, chunks, word pieces, symbols of words.

Edge cases (tests/test_extraction.py): null gives null, or no elements where the result is an array; empty texts are one empty chunk and
have no words; tags that are not closed end with the element around them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.strings import basic_tokens

# Fixed values
EXCLUDED = frozenset(["nav", "footer", "aside", "script", "style", "head", "noscript", "template", "svg", "math", "button", "select", "option", "optgroup", "datalist"])
BLOCKS = frozenset([
    "p", "div", "section", "article", "main", "header", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "ul", "ol", "li", "dt", "dd", "dl",
    "figure", "figcaption", "table", "thead", "tbody", "tfoot", "tr", "th", "td", "details", "summary", "br", "hr",
])
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
IN_HEAD = frozenset("title meta link base script style noscript template head".split())
SENTENCE, CLAUSE, LIMIT = ".!?", ",;:", 900
# End of fixed values
#: An open element that a start tag ends.
ENDS = {"p": BLOCKS - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}


class _Text(HTMLParser):
    """Text as it is read, with the words' places in it: blocks begin on new lines, white space is one space, excluded elements are left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.size, self.after_space, self.last = [], 0, True, ""
        self.open, self.opened, self.hidden, self.words = [], Counter(), 0, []

    def _add(self, text):
        self.parts.append(text)
        self.size += len(text)
        self.last = text[-1]

    def _newline(self):
        if self.size and self.last != "\n":
            self._add("\n")
        self.after_space = True

    def _pop(self):
        tag = self.open.pop()
        self.opened[tag] -= 1
        self.hidden -= tag in EXCLUDED
        if tag in BLOCKS and not self.hidden:
            self._newline()

    def handle_starttag(self, tag, attrs):
        if self.open and (tag in ENDS.get(self.open[-1], ()) or self.open[-1] == "head" and tag not in IN_HEAD):
            self._pop()
        if tag in BLOCKS and not self.hidden:
            self._newline()
        if tag not in VOID:
            self.open.append(tag)
            self.opened[tag] += 1
            self.hidden += tag in EXCLUDED

    def handle_endtag(self, tag):
        if self.opened[tag]:
            while self.open[-1] != tag:
                self._pop()
            self._pop()

    def handle_data(self, data):
        if self.hidden:
            return
        for run in re.findall(r"\s+|\S+", data):
            if not run.isspace():
                self.words.append((run, self.size, self.size + len(run)))
                self._add(run)
            elif not self.after_space:
                self._add(" ")
            self.after_space = run.isspace()


def read_html(html: str) -> tuple[str, list[tuple[str, int, int]]]:
    """(text, words): what is read of a page, and each word with its place in the text."""
    parser = _Text()
    parser.feed(html)
    parser.close()
    return "".join(parser.parts).strip(), parser.words


def html_to_text(html: Column) -> Column:
    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pages.map(lambda x: None if x is None else read_html(x)[0])

    return extract(html)


def html_words(html: Column) -> Column:
    """array<struct<word, start, end>> of the words of a page, by their places in html_to_text()."""

    @F.pandas_udf("array<struct<word:string,start:int,end:int>>")
    def extract(pages: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [dict(zip(("word", "start", "end"), w)) for w in read_html(x)[1]] for x in pages], dtype=object)

    return extract(html)


_BREAKS = [re.compile(x) for x in (rf"[{SENTENCE}]\s+", rf"[{CLAUSE}]\s+", r"\s+")]


def split_chunks(text: str, limit: int = LIMIT) -> list[tuple[str, int]]:
    """(chunk, start): cut after the last sentence end in a window, else clause, else white space; at the limit if that is in its first half.

    Starts are those before trimming; a text within the limit, and the last chunk, stay as they are.
    """
    found, start = [], 0
    while len(text) - start > limit:
        stop = limit
        for pattern in _BREAKS:
            ends = [m.end() for m in pattern.finditer(text, start, start + limit)]
            if ends:
                stop = ends[-1] - start if ends[-1] - start >= limit // 2 else limit
                break
        if chunk := text[start : start + stop].strip():
            found.append((chunk, start))
        start += stop
    return [*found, (text[start:], start)] if start < len(text) or not start else found


def split_to_fit(text: str, most: int, limit: int = LIMIT, start: int = 0) -> list[tuple[str, int]]:
    """Chunks of at most `most` characters: those that are longer are cut again, at half their length."""
    out = []
    for chunk, at in split_chunks(text, limit):
        if len(chunk) > max(1, most):
            out += split_to_fit(chunk, most, max(1, len(chunk) // 2), start + at)
        else:
            out.append((chunk, start + at))
    return out


def chunks(text: Column, limit: int = LIMIT, most: int | None = None) -> Column:
    """array<struct<text, start>>, none for null; with `most`, chunks that are longer are cut again."""

    @F.pandas_udf("array<struct<text:string,start:int>>")
    def split(texts: pd.Series) -> pd.Series:
        cut = lambda t: split_chunks(t, limit) if most is None else split_to_fit(t, most, limit)
        return pd.Series([[{"text": c, "start": s} for c, s in (cut(t) if t is not None else [])] for t in texts], dtype=object)

    return split(text)


def word_pieces(word: str, ids: dict[str, int], unknown: int) -> list[int]:
    """Greedy longest match; a word of over 100 letters, or with a part that nothing matches, is unknown."""
    found, start = [], 0
    while start < len(word) <= 100:
        stop = next((z for z in range(len(word), start, -1) if ("##" * (start > 0) + word[start:z]) in ids), None)
        if stop is None:
            return [unknown]
        found.append(ids["##" * (start > 0) + word[start:stop]])
        start = stop
    return found or [unknown]


def wordpiece_ids(text: Column, vocabulary: list[str], never_split: tuple[str, ...] = ()) -> Column:
    """Ids between [CLS] and [SEP] of the pieces of a text's basic_tokens(); letters keep their case."""

    @F.pandas_udf("array<int>")
    def encode(rows: pd.Series) -> pd.Series:
        ids = {x: i for i, x in enumerate(vocabulary)}
        known: dict[str, list[int]] = {}
        out = []
        for tokens in rows:
            row = [ids["[CLS]"]]
            for w in tokens if tokens is not None else ():
                if w not in known:
                    known[w] = word_pieces(w, ids, ids["[UNK]"])
                row += known[w]
            out.append([*row, ids["[SEP]"]])
        return pd.Series(out, dtype=object)

    return encode(basic_tokens(text, never_split))


_UNSPACED = re.compile(r"\S+")


def place_spans(source: str, tokens: Iterable[str | None]) -> list[tuple[int, int, int]]:
    """(number, start, end) of the words of each token, found in turn in the source; a token that isn't there after the last is left out."""
    found, at = [], 0
    for token in tokens:
        place = source.find(token, at) if token else -1
        if place >= 0:
            at = place + len(token)
            found += [m.span() for m in _UNSPACED.finditer(source, place, at)]
    return [(i, a, z) for i, (a, z) in enumerate(found)]


def place_tokens(source: str, tokens: Iterable[str | None]) -> list[tuple[str, int, int]]:
    """(word, start, end) of place_spans()."""
    return [(source[a:z], a, z) for _, a, z in place_spans(source, tokens)]


def token_places(source: Column, tokens: Column) -> Column:
    """array<struct<word, start, end>>: place_tokens() of a rendered page's text tokens in its source."""

    @F.pandas_udf("array<struct<word:string,start:int,end:int>>")
    def place(sources: pd.Series, lists: pd.Series) -> pd.Series:
        rows = zip(sources, lists)
        return pd.Series([None if s is None or t is None else [dict(zip(("word", "start", "end"), w)) for w in place_tokens(s, list(t))] for s, t in rows], dtype=object)

    return place(source, tokens)


def align_words(text: str, symbols: list[tuple[str, int]], offset: float, duration: float, text_offset: int = 0, frame: float = 600 / 48000) -> list[tuple[str, float, float, int, int]]:
    """(word, start, end, orig_start, orig_end) of a chunk's words in the stream of its symbols (sign, frames).

    The stream's letters are some of the text's letters, in order. A letter that is not the next one of the stream was never spoken; a
    word without spoken letters takes no time, where the next letter begins. Stress marks right before a letter begin with it.
    """
    starts, total = [], 0
    for _, frames in symbols:
        starts.append(total)
        total += frames
    starts.append(total)
    key = lambda c: c.lower()[0].replace("ё", "е")
    letters = [i for i, (c, _) in enumerate(symbols) if c.isalpha()]
    out, at = [], 0

    def onset(i: int) -> int:
        while i and symbols[i - 1][0] == "+":
            i -= 1
        return i

    for m in re.finditer(r"\w+", text):
        first = last = None
        for c in filter(str.isalpha, m[0]):
            if at < len(letters) and key(symbols[letters[at]][0]) == key(c):
                first = onset(letters[at]) if first is None else first
                last = letters[at]
                at += 1
        if first is None:
            first = onset(letters[at]) if at < len(letters) else len(symbols)
            last = first - 1
        begin, end = (round_half_up(min(offset + starts[i] * frame, offset + duration)) for i in (first, last + 1))
        out.append((m[0], begin, max(begin, end), text_offset + m.start(), text_offset + m.end()))
    return out


def round_half_up(seconds: float) -> float:
    import math

    return math.floor(seconds * 1000 + 0.5) / 1000


WORD_TIMES = "array<struct<word:string,start:double,end:double,orig_start:int,orig_end:int>>"


def aligned_words(text: Column, symbols: Column, offset: Column, duration: Column, text_offset: Column) -> Column:
    """Times of the words of each chunk; symbols: array<struct<ch, frames>>, offset: seconds of audio before the chunk."""

    @F.pandas_udf(WORD_TIMES)
    def align(texts: pd.Series, streams: pd.Series, offsets: pd.Series, durations: pd.Series, places: pd.Series) -> pd.Series:
        names = ("word", "start", "end", "orig_start", "orig_end")
        rows = zip(texts, streams, offsets, durations, places)
        return pd.Series([[dict(zip(names, w)) for w in align_words(t or "", [(s["ch"], s["frames"]) for s in x], a, d, int(p))] for t, x, a, d, p in rows], dtype=object)

    return align(text, symbols, offset, duration, text_offset)
