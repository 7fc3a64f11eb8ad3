"""Stress marks and homographs of texts that a voice is to read, with the models' answers given as tables.

Every different word is looked up and marked once, whatever its frequency. Texts are cut into blocks, which ask for each of their words
once and get the marked ones back; rows stay whole, so repeated rows and null ids give each row its text.

Edge cases (tests/test_voice.py): a null text stays null, an empty one empty; words that no table knows stay as they are, but that a
single vowel is always stressed; of repeated words in a dictionary or a model's answers, the least row counts; clashing names do no harm.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.numbers import let
from lectern.functions.strings import WHITE
from lectern.operators.words import spans
from lectern.session import settle, spread

# Fixed values
VOWELS = "аеёиоуыэюя"
STRESS = "+"
THRESHOLD = 0.5
# End of fixed values
_CYRILLIC = re.compile("[а-яёА-ЯЁ+]*[а-яёА-ЯЁ][а-яёА-ЯЁ+]*")


_RAWS = rf"[{WHITE}]+|[^{WHITE}-]*-|[^{WHITE}-]+"


def _clean(raw: Column) -> Column:
    return F.regexp_replace(F.lower(raw), "[^а-яё]+", "")


def counted_tokens(texts: DataFrame, text_col: str) -> DataFrame:
    """(raw, clean, placed, n) of the different accent_tokens() of all texts, without stop words."""
    raws = texts.select(F.explode_outer(F.regexp_extract_all(F.col(text_col), F.lit(_RAWS), F.lit(0))).alias("raw"))  # plain explode would cut texts twice, for a filter
    counts = raws.where("raw IS NOT NULL").groupBy("raw").agg(F.count("*").alias("n"))
    return counts.select("raw", _clean(F.col("raw")).alias("clean"), (_clean(F.col("raw")) != "").alias("placed"), "n")


def accent_tokens(text: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """array<struct<raw, clean, placed>>: runs of white space and of other signs, cut after hyphens; raws joined give the text.

    clean keeps Cyrillic letters, in lower case; placed says whether a mark may be set: not where clean is empty, nor in the last part of
    a hyphenated word that is a stop word.
    """
    raws = F.regexp_extract_all(text, F.lit(_RAWS), F.lit(0))

    def token(all_raws: Column) -> Column:
        def one(raw: Column, i: Column) -> Column:
            clean = _clean(raw)
            placed = clean != ""
            if stop_words:
                placed &= ~(raw.isin(*stop_words) & (i > 0) & F.coalesce(F.get(all_raws, i - 1).endswith("-"), F.lit(False)))
            return F.struct(raw.alias("raw"), clean.alias("clean"), placed.alias("placed"))

        return F.transform(all_raws, one)

    return let(raws, token) if stop_words else token(raws)


def mark_word(raw: str, stress_at: int | None, yo_at: int | None, vowel: int | None, chance: float | None, yo: int | None, yo_chance: float | None, vowels: str = VOWELS, least: float = THRESHOLD, least_yo: float = THRESHOLD) -> str:
    """A word with its stress mark: the writer's marks first, then the dictionary (stress_at, yo_at), then the model's answer.

    vowel counts vowels from 0; yo counts letters е from 1, 0 for none. A model turns е to ё only where the stress falls.
    """
    low = raw.lower()
    marked = STRESS in low
    if "ё" in low:
        return raw if marked else "".join(STRESS + c if c in "ёЁ" else c for c in raw)
    letters = list(raw)

    def to_yo(place: int) -> None:
        letters[place] = "ё" if letters[place].islower() else "Ё"

    if stress_at is not None:
        if marked:
            own = [i for i, c in enumerate(raw) if c != STRESS]
            if yo_at is not None and 0 <= yo_at < len(own) and raw[yo_at + 1 : yo_at + 2] == STRESS:
                to_yo(own[yo_at])
            return "".join(letters)
        if yo_at is not None and 0 <= yo_at < len(letters):
            to_yo(yo_at)
        if stress_at <= len(letters):
            letters.insert(stress_at, STRESS)
        return "".join(letters)
    places = [i for i, c in enumerate(low) if c in vowels]
    if not places:
        return raw
    if marked:
        counts = [sum(c in vowels for c in part) for part in low.split(STRESS)]
    else:
        counts = [] if vowel is None else [vowel]
    stressed = [places[k] for k in counts if 0 <= k < len(places)]
    if yo and yo_chance is not None and yo_chance > least_yo:
        es = [i for i, c in enumerate(low) if c == "е"]
        if yo <= len(es) and es[yo - 1] in stressed:
            to_yo(es[yo - 1])
    if not marked:
        if len(places) == 1:
            letters.insert(places[0], STRESS)
        elif stressed and chance is not None and chance > least:
            letters.insert(stressed[0], STRESS)
    return "".join(letters)


_TOKEN = re.compile(r"\s+|[^\s-]*-|[^\s-]+")
#: Signs of the texts of a block, about: the larger, the fewer blocks ask for a word.
BLOCK_SIGNS = 8 << 20


def _nullable(schema: T.StructType) -> T.StructType:
    """A schema as tables that were written have it: nothing in it is required."""
    return T.StructType.fromJson(json.loads(re.sub(r'("(?:nullable|containsNull|valueContainsNull)": ?)false', r"\1true", schema.json())))


def _blocks(texts: DataFrame, text_col: str) -> DataFrame:
    """(block, row, raws): every row of texts as a struct, without raws, and for each block a row of the different signs runs of its texts."""
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("row", _nullable(texts.schema)), T.StructField("raws", T.ArrayType(T.StringType()))])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        block, size, raws, kind = TaskContext.get().partitionId() << 32, 0, set(), None

        def asked():
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.nulls(1, kind), pa.array([sorted(raws)], pa.list_(pa.string()))], schema.names)

        for batch in batches:
            rows, kind = batch.column(0), batch.column(0).type
            for text in rows.field(text_col).to_pylist():
                if text:
                    size += len(text)
                    raws.update(_TOKEN.findall(text))
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(rows), pa.int64()), rows, pa.nulls(len(rows), pa.list_(pa.string()))], schema.names)
            if size >= BLOCK_SIGNS:
                yield asked()
                block, size, raws = block + 1, 0, set()
        if raws:
            yield asked()

    return spread(texts).select(F.struct("*").alias("row")).mapInArrow(run, schema)


def accentuate(texts: DataFrame, exceptions: DataFrame, predictions: DataFrame, text_col: str = "text", stop_words: tuple[str, ...] = (), vowels: str = VOWELS, least: float = THRESHOLD, least_yo: float = THRESHOLD) -> DataFrame:
    """texts with `voiced`: each text with its stress marks.

    exceptions: (word, stress, yo) by letters, yo -1 for none. predictions: (word, vowel, chance, yo, yo_chance), a model's answers.
    """
    texts = texts.select(*[F.col(f"`{c}`") for c in texts.columns if c != "voiced" or c == text_col])
    blocks = settle(_blocks(texts, text_col), "blocks")
    known = exceptions.groupBy("word").agg(F.min(F.struct("stress", "yo")).alias("known"))
    guessed = predictions.groupBy("word").agg(F.min(F.struct("vowel", "chance", F.col("yo").alias("yo_vowel"), "yo_chance")).alias("guessed"))
    asked = blocks.where("row IS NULL").select("block", F.explode("raws").alias("raw")).groupBy("raw").agg(F.collect_list("block").alias("blocks"))
    each = asked.withColumn("word", _clean(F.col("raw"))).where("word <> ''").join(known, "word", "left").join(guessed, "word", "left")

    @F.pandas_udf("string")
    def mark(raw: pd.Series, stress: pd.Series, yo_at: pd.Series, vowel: pd.Series, chance: pd.Series, yo: pd.Series, yo_chance: pd.Series) -> pd.Series:
        number = lambda x: None if pd.isna(x) else int(x)
        share = lambda x: None if pd.isna(x) else float(x)
        rows = zip(raw, stress, yo_at, vowel, chance, yo, yo_chance)
        return pd.Series([mark_word(r, number(s), number(y), number(v), share(c), number(u), share(d), vowels, least, least_yo) for r, s, y, v, c, u, d in rows], dtype=object)

    said = mark(F.col("raw"), F.col("known.stress"), F.col("known.yo"), F.col("guessed.vowel"), F.col("guessed.chance"), F.col("guessed.yo_vowel"), F.col("guessed.yo_chance"))
    marked = each.select("raw", "blocks", said.alias("said")).where("said <> raw").select(F.explode("blocks").alias("block"), "raw", "said")

    def voice(text: str | None, said: dict[str, str]) -> str | None:
        if text is None:
            return None
        out, cut = _TOKEN.findall(text), False
        for i, raw in enumerate(out):
            if not (cut and raw in stop_words):
                out[i] = said.get(raw, raw)
            cut = raw.endswith("-")
        return "".join(out)

    def joined(own, answers):
        import pyarrow as pa

        said = dict(zip(answers.column("raw").to_pylist(), answers.column("said").to_pylist()))
        row = own.column("row").combine_chunks()
        voiced = [voice(x, said) for x in row.field(text_col).to_pylist()]
        return pa.table([own.column("row"), pa.array(voiced, pa.string())], ["row", "voiced"])

    schema = T.StructType([T.StructField("row", _nullable(texts.schema)), T.StructField("voiced", T.StringType())])
    done = blocks.where("row IS NOT NULL").select("block", "row").groupBy("block").cogroup(marked.groupBy("block")).applyInArrow(joined, schema)
    return done.select(*[F.col(f"row.`{c}`") for c in texts.columns if c != "voiced"], "voiced")


def ngram_ids(words: DataFrame, ngrams: DataFrame, unknown: int, word_col: str = "word") -> DataFrame:
    """(word, ids): ids of the known character n-grams of `<word>` by length and place, or the unknown id alone, for each different word.

    ngrams: (gram, id). Grams longer than any known one are never made, so long words cost in proportion to their length.
    """
    known = ngrams.groupBy("gram").agg(F.min("id").alias("id"))
    longest = ngrams.agg(F.max(F.length("gram"))).first()[0] or 1
    distinct = words.select(F.col(word_col).alias("word")).where("word IS NOT NULL").distinct()
    padded = F.concat(F.lit("<"), F.col("word"), F.lit(">"))
    sizes = F.sequence(F.lit(1), F.least(F.length(padded), F.lit(longest)))
    grams = distinct.select("word", padded.alias("padded"), F.explode(sizes).alias("size"))
    grams = grams.select("word", "size", "padded", F.explode(F.sequence(F.lit(1), F.length("padded") - F.col("size") + 1)).alias("at"))
    grams = grams.select("word", "size", "at", F.substring(F.col("padded"), F.col("at"), F.col("size")).alias("gram"))
    found = grams.join(known, "gram", "left").groupBy("word").agg(F.sort_array(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("size", "at", "id")))).alias("found"))
    return found.select("word", F.when(F.size("found") > 0, F.col("found.id")).otherwise(F.array(F.lit(unknown).cast("long"))).alias("ids"))


def bag_offsets(ids: Column) -> Column:
    """Where each word's ids begin once array<array<id>> is flattened."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(ids, zero, lambda acc, x: F.struct((acc["at"] + F.size(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]


def homograph_words(texts: DataFrame, homographs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, idx, word, start, end_pos, variants): Cyrillic words, marks included, that a table (word, variants) knows; variants sorted."""
    known = homographs.groupBy("word").agg(F.min(F.sort_array("variants")).alias("variants"))
    words = spans(texts, [id_col], text_col, lambda t: [(i, *m.span()) for i, m in enumerate(_CYRILLIC.finditer(t))])
    found = words.withColumn("known word", F.lower("word")).join(known.withColumnRenamed("word", "known word"), "known word")
    return found.select(id_col, "idx", "word", "start", "end_pos", "variants")


def marked_homograph(text: Column, start: Column, end: Column) -> Column:
    """The text that a model is asked about: one homograph between signs of its own."""
    word = F.concat(F.lit(" [HOMO] "), F.substring(text, start + 1, end - start), F.lit(" [/HOMO] "))
    return F.concat(F.substring(text, F.lit(1), start), word, F.substring(text, end + 1, F.length(text)))


def choose_variant(variants: Column, logit: Column) -> Column:
    """The variant that a model's logit names, its chance rounded half to even; null where there is no such variant."""
    chosen = F.bround(F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)), 0).cast("int")
    return F.get(variants, chosen)


def splice(text: str, choices: list[tuple[int, int, str | None]]) -> str:
    """A text with variants in place of words (start, end, variant), letters in the case of the words'; null variants change nothing."""
    out, at = [], 0
    for start, end, variant in sorted((c for c in choices if c[2] is not None), key=lambda c: c[:2]):
        if start < at:
            continue
        said = [v.lower() if own.islower() else v.upper() for own, v in zip(text[start:end], variant.replace(STRESS, ""))]
        if STRESS in variant:
            said.insert(variant.index(STRESS), STRESS)
        out += [text[at:start], *said]
        at = end
    return "".join([*out, text[at:]])


def resolve_homographs(text: Column, choices: Column) -> Column:
    """splice() over rows; choices: array<struct<start, end_pos, variant>>, null for none."""

    @F.pandas_udf("string")
    def resolve(texts: pd.Series, chosen: pd.Series) -> pd.Series:
        each = lambda c: [(x["start"], x["end_pos"], x["variant"]) for x in c] if c is not None else []
        return pd.Series([None if t is None else splice(t, each(c)) for t, c in zip(texts, chosen)], dtype=object)

    return resolve(text, choices)
