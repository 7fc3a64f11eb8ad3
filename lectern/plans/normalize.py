"""Speakable text with provenance.

1. An Arrow function cuts each document: an ordered list of patterns finds what is to be read, and each part of the source is taken by
   one pattern at most (lectern/operators/tracked.py). A part is a literal change or a question: a kind and a text to be read.
   Documents lie in blocks, whose parts name their literals and questions by number: a block holds each of these once.
2. The different questions of all blocks are read once, by Column expressions of each kind, and joined to the blocks that ask them; only
   these short rows, one for each question of a block, are shuffled by what they ask.
3. The documents of a block meet its readings, where each is put together from its free text, its literals and the readings.

Edge cases (tests/test_normalize.py): null and empty texts, and texts of white space, give an empty text without parts; rows are told
apart even if ids are null or repeat; texts of several megabytes are cut in time linear in their length; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

from lectern.functions import lexicon as L
from lectern.functions import numbers as N
from lectern.functions import strings as S
from lectern.functions import urls as U
from lectern.operators.tracked import Notes, Tracked
from lectern.session import forget, settle, spread

# The patterns, which decide what is read as what.
FENCED = re.compile(r"(?s)```(\w*)\n(.*?)```")
DIRECTIVE = re.compile(r"<!--\s*[a-z]+-code:\s*(full|brief)\s*-->")
INLINE = re.compile(r"`([^`\n]+)`")
HEADING = re.compile(r"(?m)^#{1,6}\s+")
LIST_NUMBER = re.compile(r"(?m)^(\d+)\.\s+")
URL = re.compile(r"""(?:https?|ftp|ssh|git)://[^\s<>"')]+""")
EMAIL = re.compile(r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}")
BARE_URL = re.compile(r"""\b(?:[a-zA-Z0-9-]++\.)+[a-zA-Z0-9-]++(?:/[^\s<>"')]*)?""")
IP = re.compile(r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b")
PATH = re.compile(r"[~/][a-zA-Z0-9_./ \-]+\.[a-zA-Z0-9]+|[~/][a-zA-Z0-9_./\-]+")
SIZE = re.compile(r"(?i)(\d(?<!\w\d)\d*(?:\.\d+)?)\s*(KB|MB|GB|TB|ms|sec|min|hr|px|em|rem|vh|vw|кб|мб|гб|тб)\b")
DATES = re.compile(r"\b(\d{4})-(\d{2})-(\d{2})\b"), re.compile(r"\b(\d{1,2})\.(\d{1,2})\.(\d{4})\b")
TIME = re.compile(r"\b(\d{1,2}):(\d{2})(?::(\d{2}))?\b")
PERCENT_RANGE, PERCENT = re.compile(r"\b(\d+)\s*-\s*(\d+)\s*%"), re.compile(r"\b(\d+(?:\.\d+)?)\s*%")
RANGE = re.compile(r"(\d(?<!\w\d)\d*)\s*-\s*(\d+)\b")
VERSION = re.compile(r"(?i)\bv?\d+\.\d+(?:\.\d+)?(?:-(?:alpha|beta|rc|dev|stable|release)\d*)?\b")
FRACTION = re.compile(r"(^|[^\w./\\])\.(\d+)")
SIGNS = re.compile("|".join(re.escape(x) for x in sorted(L.OPERATORS, key=len, reverse=True)) + "|[" + "".join(L.SYMBOLS) + "]")
ABOUT = re.compile(r"~\s*(\d)")
CAMEL = re.compile(r"\b[a-z]+(?:[A-Z][a-z]*)+\b"), re.compile(r"\b[A-Z][a-z]+(?:[A-Z][a-z]+)+\b")
SNAKE, KEBAB = re.compile(r"\b[a-zA-Z_][a-zA-Z0-9]*(?:_[a-zA-Z0-9]+)+\b"), re.compile(r"\b[a-zA-Z][a-zA-Z0-9]*(?:-[a-zA-Z0-9]+)+\b")
LANGUAGES = {"C++": "си плюс плюс", "c++": "си плюс плюс", "C#": "си шарп", "c#": "си шарп", "F#": "эф шарп", "f#": "эф шарп"}
LANGUAGE = re.compile(r"[Cc]\+\+|[CcFf]#")
WORD, NUMBER = re.compile(r"([A-Za-z](?<!\w[A-Za-z])[A-Za-z]*\b)"), re.compile(r"\d(?<!\w\d)\d*\b")
QUOTES = {"«": '"', "»": '"', "“": '"', "”": '"', "‘": "'", "’": "'", "—": "-", "–": "-"}
QUOTE, NEWLINES, BLANKS = re.compile("[" + "".join(QUOTES) + "]"), re.compile(r"\n{3,}"), re.compile(r"[ \t]{2,}|\t")
SPACES, BEFORE_SIGN, AFTER_LINE, BEFORE_LINE = re.compile(" {2,}"), re.compile(" +([.,!?;:])"), re.compile("\n +"), re.compile(" +\n")
DIAGRAM, NO_LANGUAGE, SOME_LANGUAGE = "Тут мермэйд диаграмма", "далее следует блок кода", "далее следует пример кода на "
# End of fixed values

#: What a text must hold for a pattern to match anywhere in it; where it is not there, the pattern is not tried.
DOTTED = re.compile(r"\.(?<=[a-zA-Z0-9-]\.)[a-zA-Z0-9-]")
DOT_DIGIT, DASH_DIGIT, COLON_DIGIT, DIGIT = re.compile(r"\.\d"), re.compile(r"-\s*\d"), re.compile(r":\d"), re.compile(r"\d")
HUMP, DASHED = re.compile("[a-z][A-Z]"), re.compile("-(?<=[a-zA-Z0-9]-)[a-zA-Z0-9]")

#: White space at the ends of what is said.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: What stands in the text for a reading while patterns run: a word, as readings begin and end with letters.
STAND = "жж"
MAX_LONG = 2**63 - 1


def _whole(digits: str) -> bool:
    return digits.isascii() and len(digits.lstrip("0")) < 20 and int(digits) <= MAX_LONG


def asked(kind: str, text: str, before: str = "", after: str = "") -> tuple[str, tuple[str, str, str, str]]:
    return before + STAND + after, (kind, text, before, after)


def _block(m: re.Match, brief: bool):
    language, code = m[1], m[2].strip()
    if language.lower() == "mermaid":
        return DIAGRAM
    if brief:
        return SOME_LANGUAGE + L.LANGUAGES.get(language.lower(), language) if language else NO_LANGUAGE
    return asked("code", code)


def _inline(m: re.Match):
    text = m[1]
    special = any(c in L.SYMBOLS for c in text)
    if special:
        text = "".join(f" {L.SYMBOLS[c]} " if c in L.SYMBOLS and (c.isalpha() or c in L.ARROWS) else c for c in text)
        special = text != m[1]
    text = " ".join(text.split())
    if not special:
        if "_" in text:
            return asked("snake", text)
        if "-" in text and not text.startswith("-"):
            return asked("kebab", text)
        if any(c.isupper() for c in text[1:]) and any(c.islower() for c in text):
            return asked("camel", text)
    return asked("words", text)


def _links(text: str) -> Iterator[tuple[int, int, str, None]]:
    """The bracket before a link's text, and what follows the text; the text itself stays as it is."""
    done, at = 0, text.find("](")
    while at >= 0:
        start = text.find("[", max(done, text.rfind("]", done, at) + 1), at)
        stop = text.find(")", at + 2)
        if stop < 0:
            return
        if 0 <= start < at - 1 and stop > at + 2:
            yield start, start + 1, "", None
            yield at, stop + 1, "", None
            done = stop + 1
        at = text.find("](", max(done, at + 2))


def _url(kind: str, url: str):
    core = url.rstrip(".,;:!?")
    return asked(kind, core, "", url[len(core) :])


def _bare_url(m: re.Match):
    core = m[0].rstrip(".,;:!?")
    labels = re.split("[/?#]", core, maxsplit=1)[0].lower().split(".")
    after_slash = m.start() and m.string[m.start() - 1] in "/\\"
    return None if after_slash or not (labels[0] == "www" or labels[-1] in L.TLDS) else _url("host", m[0])


def _date(year: str, month: str, day: str, text: str):
    return asked("date", text) if text.isascii() and int(year) > 0 and 1 <= int(month) <= 12 and 1 <= int(day) <= 31 else None


def _time(m: re.Match):
    return asked("time", m[0]) if m[0].isascii() and int(m[1]) < 24 and int(m[2]) < 60 and int(m[3] or 0) < 60 else None


def _numbered(m: re.Match):
    n = int(m[1]) if m[1].isascii() and len(m[1]) <= 10 and int(m[1]) < 2**32 else 0
    return L.LIST_ORDINALS[n] + ":" if 1 <= n <= 10 else asked("number", str(n), "", ":")


def _number(m: re.Match):
    text, a, z = m.string, m.start(), m.end()
    apart = (not a or text[a - 1] != ".") and not (text[z : z + 1] == "." and text[z + 1 : z + 2].isdigit() and text[z + 1].isascii())
    return asked("number", m[0]) if apart and _whole(m[0]) else None


def _word(text: str):
    return "word", text, "", ""


def cut(source: str, brief: bool = False, notes: Notes | None = None) -> Tracked:
    """A text cut by all patterns; notes of its parts are new texts, or (kind, text, before, after) for what is to be read."""
    t = Tracked(source, notes)
    if source.startswith("﻿"):
        t.replace("﻿", "")
    blocks = []
    if "```" in t.text:
        modes = [(m.start(), m[1] == "brief") for m in DIRECTIVE.finditer(t.text)]
        for m in FENCED.finditer(t.text):
            mode = next((x for at, x in reversed(modes) if at < m.start()), brief)
            new = _block(m, mode)
            blocks.append((m.start(), m.end(), *((new, None) if isinstance(new, str) else new)))
    t.rewrite(blocks)
    t.sub(DIRECTIVE, lambda m: "")
    t.sub(QUOTE, lambda m: QUOTES[m[0]])
    if "\n\n\n" in t.text:
        t.sub(NEWLINES, lambda m: "\n\n")
    if "  " in t.text or "\t" in t.text:
        t.sub(BLANKS, lambda m: " ")
    t.sub(INLINE, _inline)
    if "#" in t.text:
        t.sub(HEADING, lambda m: "")
    t.rewrite(_links(t.text))
    digits = DIGIT.search(t.text)  # no later change adds one
    if digits:
        t.sub(LIST_NUMBER, _numbered)
    if "://" in t.text:
        t.sub(URL, lambda m: _url("url", m[0]))
    if "@" in t.text:
        t.sub(EMAIL, lambda m: asked("email", m[0]))
    if DOTTED.search(t.text):
        t.sub(BARE_URL, _bare_url)
    if digits and DOT_DIGIT.search(t.text):
        t.sub(IP, lambda m: asked("ip", m[0]))
    if "/" in t.text:
        t.sub(PATH, lambda m: asked("path", m[0]) if "/" in m[0] else None)
    if digits:
        _cut_numbers(t)
    t.sub(SIGNS, lambda m: f" {L.OPERATORS.get(m[0]) or L.SYMBOLS[m[0]]} ")
    if digits and "~" in t.text:
        t.sub(ABOUT, lambda m: "около " + m[1])
    if HUMP.search(t.text):
        for pattern in CAMEL:
            t.sub(pattern, lambda m: asked("camel", m[0]))
    if "_" in t.text:
        t.sub(SNAKE, lambda m: asked("snake", m[0]))
    if DASHED.search(t.text):
        t.sub(KEBAB, lambda m: asked("kebab", m[0]))
    if "+" in t.text or "#" in t.text:
        t.sub(LANGUAGE, lambda m: LANGUAGES[m[0]])
    t.sub_texts(WORD, STAND, _word)
    if digits:
        t.sub(NUMBER, _number)
    if "  " in t.text:
        t.sub(SPACES, lambda m: " ")
    t.sub(BEFORE_SIGN, lambda m: m[1])
    if "\n " in t.text:
        t.sub(AFTER_LINE, lambda m: "\n")
    if " \n" in t.text:
        t.sub(BEFORE_LINE, lambda m: "\n")
    return t


def _cut_numbers(t: Tracked) -> None:
    """The patterns of sizes, dates, times and numbers with signs, of a text that has digits."""
    t.sub(SIZE, lambda m: asked("size", m[0]) if m[1].isascii() and ("." in m[1] or _whole(m[1])) else None)
    if DASH_DIGIT.search(t.text):
        t.sub(DATES[0], lambda m: _date(m[1], m[2], m[3], m[0]))
    if DOT_DIGIT.search(t.text):
        t.sub(DATES[1], lambda m: _date(m[3], m[2], m[1], m[0]))
    if COLON_DIGIT.search(t.text):
        t.sub(TIME, _time)
    if "%" in t.text:
        t.sub(PERCENT_RANGE, lambda m: asked("range", f"{m[1]}-{m[2]}", "", " процентов") if _whole(m[1]) and _whole(m[2]) else None)
        t.sub(PERCENT, lambda m: asked("percent", m[0]) if "." in m[1] or _whole(m[1]) else None)
    if DASH_DIGIT.search(t.text):
        t.sub(RANGE, lambda m: asked("range", m[0]) if _whole(m[1]) and _whole(m[2]) else None)
    if DOT_DIGIT.search(t.text):
        t.sub(VERSION, lambda m: asked("version", m[0]))
        t.sub(FRACTION, lambda m: asked("float", "0." + m[2], m[1]))


Terms = dict[str, str] | None


def readings(terms: Terms = None, code_terms: Terms = None) -> dict[str, Callable[[Column], Column]]:
    """What is said for a text of each kind."""
    return {
        "code": lambda x: S.code_block_words(x, code_terms), "words": lambda x: S.code_words(x, code_terms),
        "snake": lambda x: S.read_parts(S.split_snake_case(x), code_terms), "kebab": lambda x: S.read_parts(S.split_kebab_case(x), code_terms),
        "camel": lambda x: S.read_parts(S.split_camel_case(x), code_terms), "url": lambda x: U.url_reading(x, terms),
        "host": lambda x: U.host_and_tail(x, terms), "email": lambda x: U.email_reading(x, terms), "ip": N.ip_words,
        "path": lambda x: U.path_reading(x, terms), "size": N.size_words, "date": N.date_words, "time": N.time_words,
        "percent": N.percent_words, "range": N.range_words, "version": N.version_words, "float": N.float_words, "number": N.number_words,
        "word": lambda x: S.english_word(x, terms),
    }


#: Signs of the texts of a block, about: the larger, the fewer blocks ask for a word.
BLOCK_SIGNS = 4 << 20


@lru_cache(1)
def _part_type() -> T.ArrayType:
    fields = [("free", "string"), ("start", "int"), ("stop", "int"), ("out", "string")]
    return T.ArrayType(T.StructType([T.StructField(x, T.StringType() if y == "string" else T.IntegerType()) for x, y in fields]))


def packed(t: Tracked) -> bytes:
    """The parts of a text: free characters before each, its characters in the source and the number of its note, in as few bytes as they fit."""
    gaps = t.source_start - np.concatenate(([0], t.source_stop[:-1])) if len(t.source_stop) else t.source_start
    columns = (gaps, t.source_stop - t.source_start, t.numbers)
    width = [next(w for w in (1, 2, 4) if x.max(initial=0) < 256**w) for x in columns]
    return bytes(width) + b"".join(x.astype(f"<u{w}").tobytes() for x, w in zip(columns, width))


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, number) of the parts in the source."""
    width, at, columns = tuple(data[:3]), 3, []
    n = (len(data) - 3) // sum(width)
    for w in width:
        columns.append(np.frombuffer(data, f"<u{w}", n, at).astype(np.int64))
        at += n * w
    stop = np.cumsum(columns[0] + columns[1])
    return stop - columns[1], stop, columns[2]


def cut_documents(docs: DataFrame, id_col: str, text_col: str, brief: bool = False) -> DataFrame:
    """(block, id, free, parts, notes): every row of docs with what its packed parts leave of its text, and for each block of rows one row of their different notes.

    notes: array<struct<kind, text, before, after>>, by number; the kind of a literal, which is `before`, is null.
    """
    note_type = T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in ("kind", "text", "before", "after")]))
    fields = [T.LongType(), docs.schema[id_col].dataType, T.StringType(), T.BinaryType(), note_type]
    schema = T.StructType([T.StructField(x, y) for x, y in zip(("block", "id", "free", "parts", "notes"), fields)])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        listed = pa.list_(pa.struct([(x, pa.string()) for x in ("kind", "text", "before", "after")]))
        block, signs, notes, kind = TaskContext.get().partitionId() << 32, 0, Notes(), None

        def noted():
            each = [{"before": x} if isinstance(x, str) else dict(zip(("kind", "text", "before", "after"), x)) for x in notes]
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.nulls(1, kind), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.array([each], listed)], schema.names)

        for batch in batches:
            kind, free, parts = batch.column(0).type, [], []
            for source in batch.column(1).to_pylist():
                source = source or ""
                t = cut(source, brief, notes)
                free.append("".join([source[a:z] for a, z in zip([0, *t.source_stop.tolist()], [*t.source_start.tolist(), len(source)])]))
                parts.append(packed(t))
                signs += len(source)
            n = len(parts)
            yield pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), batch.column(0), pa.array(free, pa.string()), pa.array(parts, pa.binary()), pa.nulls(n, listed)], schema.names)
            if signs >= BLOCK_SIGNS:
                if notes:
                    yield noted()
                block, signs, notes = block + 1, 0, Notes()
        if notes:
            yield noted()

    return spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).mapInArrow(run, schema)


def read_all(questions: DataFrame, terms: Terms = None, code_terms: Terms = None) -> DataFrame:
    """(kind, text, said) of a stored table of different questions (kind, text)."""
    known = readings(terms, code_terms)
    kinds = sorted(r.kind for r in questions.select("kind").distinct().collect())  # at most as many as there are readings
    each = [questions.where(F.col("kind") == k).select("kind", "text", known[k](F.col("text")).alias("said")) for k in kinds]
    return reduce(DataFrame.unionByName, each) if each else questions.withColumn("said", F.lit(None).cast("string"))


def normalize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: Terms = None, code_terms: Terms = None, brief: bool = False, dictionary: DataFrame | None = None) -> DataFrame:
    """(id, normalized, parts, tail) for every row of docs; id has id_col's name.

    parts: array<struct<free, start, stop, out>>, the source before a part, the part's range in the source, and what it has become; tail
    is the source behind them. terms add to, or replace, the readings of prose and URLs, code_terms those of identifiers; brief names
    blocks of code instead of reading them, where no directive in the text says otherwise. A dictionary, a table (term, said) of any
    size, comes before all other readings of words of prose, whatever their case; of equal terms the least reading counts.
    """
    return _put_together(*_cut_and_read(docs, id_col, text_col, terms, code_terms, brief, dictionary), id_col, True)


def spoken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", terms: Terms = None, code_terms: Terms = None, brief: bool = False, dictionary: DataFrame | None = None) -> DataFrame:
    """(id, normalized, rewritten) for every row of docs: as normalize(), with the number of the parts alone."""
    return _put_together(*_cut_and_read(docs, id_col, text_col, terms, code_terms, brief, dictionary), id_col, False)


def _cut_and_read(docs: DataFrame, id_col: str, text_col: str, terms: Terms, code_terms: Terms, brief: bool, dictionary: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(block, id, free, parts) of the documents, and (asking, number, out) of the notes of each block."""
    cuts = settle(cut_documents(docs, id_col, text_col, brief), "cut")
    notes = cuts.where("notes IS NOT NULL").select(F.col("block").alias("asking"), F.posexplode("notes").alias("number", "note")).select("asking", "number", "note.*")
    questions = settle(notes.where("kind IS NOT NULL").select("kind", "text").distinct(), "questions")
    said = read_all(questions, terms, code_terms)
    if dictionary is not None:
        one = dictionary.where("said IS NOT NULL").groupBy(F.lower("term").alias("term")).agg(F.min("said").alias("own"))
        said = said.join(one, (F.col("kind") == "word") & (F.lower("text") == F.col("term")), "left").select("kind", "text", F.coalesce("own", "said").alias("said"))
    said = settle(said, "said")
    forget(questions)
    read = notes.join(said, ["kind", "text"]).select("asking", "number", F.concat("before", F.coalesce("said", F.lit("")), "after").alias("out"))
    literals = notes.where("kind IS NULL").select("asking", "number", F.col("before").alias("out"))
    return cuts.where("notes IS NULL").drop("notes"), read.unionByName(literals)


def _put_together(documents: DataFrame, answers: DataFrame, id_col: str, with_parts: bool) -> DataFrame:
    """Every document from its free text and what its block's notes have become."""

    def run(own, said):
        import pyarrow as pa

        out = [""] * said.num_rows
        for k, x in zip(said.column("number").to_pylist(), said.column("out").to_pylist()):
            out[k] = x
        texts, sizes, tails, free, each, places = [], [], [], [], [], []
        for kept, data in zip(own.column("free").to_pylist(), own.column("parts").to_pylist()):
            start, stop, number = unpacked(data)
            ends = (start - np.cumsum(stop - start) + (stop - start)).tolist()  # of the free text before each part, among all of it
            pieces = [""] * (2 * len(ends) + 1)
            pieces[::2] = [kept[a:z] for a, z in zip([0, *ends], [*ends, len(kept)])]
            pieces[1::2] = map(out.__getitem__, number.tolist())
            texts.append("".join(pieces).strip(WHITE))
            sizes.append(len(ends))
            if with_parts:
                tails.append(pieces[-1])
                free += pieces[:-1:2]
                each += pieces[1::2]
                places.append((start, stop))
        columns = [own.column("id"), pa.array(texts, pa.string())]
        if not with_parts:
            return pa.table([*columns, pa.array(sizes, pa.int32())], schema.names)
        start, stop = (pa.array(np.concatenate(x), pa.int32()) for x in zip(*places))
        struct = pa.StructArray.from_arrays([pa.array(free, pa.string()), start, stop, pa.array(each, pa.string())], ["free", "start", "stop", "out"])
        parts = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), struct)
        return pa.table([*columns, parts, pa.array(tails, pa.string())], schema.names)

    more = [T.StructField("parts", _part_type()), T.StructField("tail", T.StringType())] if with_parts else [T.StructField("rewritten", T.IntegerType())]
    schema = T.StructType([T.StructField("id", documents.schema["id"].dataType), T.StructField("normalized", T.StringType()), *more])
    done = documents.groupBy("block").cogroup(answers.groupBy("asking")).applyInArrow(run, schema)
    return done.withColumnRenamed("id", id_col)


def char_map(normalized: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, normalized, char_map array<struct<start, end>>): the source range of every character of the normalized text."""
    place = lambda a, z: F.struct(a.cast("int").alias("start"), z.cast("int").alias("end"))
    own = lambda start, text: F.when(F.length(text) > 0, F.transform(F.sequence(start, start + F.length(text) - 1), lambda i: place(i, i + 1))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    of_part = lambda p: F.concat(own(p["start"] - F.length(p["free"]), p["free"]), F.array_repeat(place(p["start"], p["stop"]), F.length(p["out"])))
    last = F.when(F.size("parts") > 0, F.element_at("parts", -1)["stop"]).otherwise(F.lit(0))
    full = F.concat(F.flatten(F.transform("parts", of_part)), own(last, F.col("tail")))
    text = F.concat(F.array_join(F.transform("parts", lambda p: F.concat(p["free"], p["out"])), ""), F.col("tail"))
    lead = F.length(text) - F.length(F.regexp_replace(text, r"(?U)\A\s+", ""))
    return normalized.select(id_col, "normalized", F.slice(full, lead + 1, F.length("normalized")).alias("char_map"))


def provenance(normalized: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, part, orig_start, orig_end, norm_start, norm_end): where each rewritten part comes from and lies, before trimming."""
    each = normalized.select(id_col, F.posexplode("parts").alias("part", "p")).select(id_col, "part", "p.start", "p.stop", F.length("p.free").alias("free"), F.length("p.out").alias("size"))
    run = F.sum(F.col("free") + F.col("size")).over(Window.partitionBy(id_col).orderBy("part"))
    return each.withColumn("norm_end", run).select(id_col, "part", F.col("start").alias("orig_start"), F.col("stop").alias("orig_end"), (F.col("norm_end") - F.col("size")).alias("norm_start"), "norm_end")
