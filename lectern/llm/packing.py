"""Packing of token sequences into windows by best-fit decreasing.

Documents are tokenised and ended with one id; overlong ones are first cut into full windows. What is left of each document goes,
longest first, into the open window with the least room that still holds it, found in a segment tree over remaining capacities.
Pieces are dealt to groups of about GROUP_WINDOWS windows at random, so each task packs a group and at most the last few windows
of a group are not full; with so many pieces in a group the padding is a small fraction of a percent.

Edge cases (tests/llm/test_packing.py): null and empty texts are one piece that holds the end id alone; repeated rows are packed
as often as they occur; a null id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.session import settle

WINDOW = 4096
END_ID = 2
#: A group holds about so many windows, and about so many pieces.
GROUP_WINDOWS, GROUP_PIECES = 2048, 50_000
#: Words whose ids a Python worker remembers, about.
REMEMBERED = 800_000


#: What WordTokenizer relies on: white space splits before anything else, letters are lower-cased, a word's last token has a suffix.
SPLITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters that normalisation leaves alone, and signs that never join a letter before them.
LETTERS, SIGNS = "a-zß-öø-ÿ", "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def goes_by_words(spec: dict) -> bool:
    """Whether a tokenizer's file says that the ids of a text are those of its words, lower-cased."""
    normal, split = spec.get("normalizer") or {}, (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    kinds = [x.get("type") for x in normal.get("normalizers") or []]
    pattern = split[0].get("pattern") or {}
    return kinds == ["NFC", "Replace", "Lowercase"] and split[0].get("behavior") == "Removed" and pattern.get("Regex") == SPLITS and spec["model"].get("end_of_word_suffix") == "</w>"


class WordTokenizer:
    """Ids of whole texts as little-endian unsigned 32-bit values.

    Where the tokenizer goes by words, they are looked up instead of merged again: vocabularies of text reuse most words. Those of the
    last REMEMBERED or so are kept, in two generations, so that frequent words stay. Other tokenizers read every text in full.
    """

    _at: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        import json
        import re

        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.no_padding(), self.full.no_truncation()
        self.by_words = goes_by_words(json.loads(self.full.to_str()))
        self.plain = re.compile(f"[{LETTERS}]+").fullmatch
        self.known: dict[str, bytes] = {"": b""}
        self.former: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}
        self.remembered = REMEMBERED
        self.last = {i for x, i in self.full.get_vocab().items() if x.endswith("</w>")} if self.by_words else set()

    @classmethod
    def at(cls, path: str) -> WordTokenizer:
        if path not in cls._at:
            cls._at[path] = cls(path)
        return cls._at[path]

    def _slow(self, texts: list[str]) -> list[bytes]:
        from array import array

        return [array("I", x.ids).tobytes() for x in self.full.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, which end with a token of `last` each."""
        from array import array

        out, last = [], self.last
        for low in range(0, len(words), 2000):
            part = words[low : low + 2000]
            ids = array("I", self.full.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids)
            ends = [i for i, x in enumerate(ids, 1) if x in last]
            if len(ends) != len(part):
                return out + self._slow(words[low:])
            flat = ids.tobytes()
            out += [flat[4 * a : 4 * z] for a, z in zip([0, *ends], ends)]
        return out

    def _learn(self, new: set[str]) -> None:
        known, former, marks, plain = self.known, self.former, self.marks, self.plain
        stems: dict[str, str] = {}
        rest, found = [], {}
        for w in new:
            if w in former:
                known[w] = former[w]
                continue
            x = w.rstrip(SIGNS).lower()
            if plain(x):
                stems[w] = x
                found[x] = known.get(x) or former.get(x)
            else:
                rest.append(w)
        known.update(zip(rest, self._slow(rest)))
        words = [x for x, ids in found.items() if not ids]
        found.update(zip(words, self._letters(words)))
        for w, x in stems.items():
            mark = w[len(x) :]
            if mark not in marks:
                if len(marks) > self.remembered // 10:
                    marks.clear()
                marks[mark] = self._slow([mark])[0]
            known[w] = found[x] + marks[mark] if mark else found[x]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return self._slow(texts)
        parts = [x.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for x in texts]
        words = set().union(*parts)
        if new := words.difference(self.known):
            if len(self.known) > self.remembered // 2:  # before all words of these texts are learned: they are looked up below, however many they are
                self.known, self.former = {"": b""}, self.known
                new = words.difference(self.known)
            self._learn(new)
        return [b"".join(map(self.known.__getitem__, x)) for x in parts]


def narrow(ids: bytes) -> bytes:
    """32-bit ids as 16-bit ones where all fit, which halves what is stored and shuffled; the number of ids tells which."""
    import numpy as np

    wide = np.frombuffer(ids, "<u4")
    return wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 1 << 16 else ids


def widened(column, lengths):
    """array<int> of narrow() bytes."""
    import numpy as np
    import pyarrow as pa

    cuts = [np.frombuffer(x, "<u2" if len(x) == 2 * n else "<u4").astype(np.int32) for x, n in zip(column.to_pylist(), lengths.tolist())]
    ends = np.cumsum([0] + [len(x) for x in cuts]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(cuts) if cuts else np.zeros(0, np.int32)))


def squeezed(data: bytes) -> bytes:
    """Bytes at even places before those at odd ones, compressed: less is stored and shuffled."""
    import zstandard

    return zstandard.compress(data[::2] + data[1::2], 3)


def unsqueezed(data: bytes) -> bytes:
    import zstandard

    both = zstandard.decompress(data)
    whole, half = bytearray(len(both)), (len(both) + 1) // 2
    whole[::2], whole[1::2] = both[:half], both[half:]
    return bytes(whole)


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False, remembered: int | None = None) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids]): full windows of each document and what is left; ids in squeezed narrow() bytes."""
    fields = [T.StructField("id", docs.schema[id_col].dataType)] + [T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32", "doc_tokens")]
    if with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))

    def run(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        known, step, end = WordTokenizer.at(tokenizer), 4 * window, int(end_id).to_bytes(4, "little")
        known.remembered = remembered or REMEMBERED
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                rows, starts, cuts, totals = [], [], [], []
                for i, ids in enumerate(known.encode([x or "" for x in part.column(1).to_pylist()])):
                    ids += end
                    for k in range(0, len(ids), step):
                        rows.append(i)
                        starts.append(k // 4)
                        cuts.append(ids[k : k + step])
                        totals.append(len(ids) // 4)
                columns = [part.column(0).take(pa.array(rows, pa.int32())), pa.array(starts, pa.int64()), pa.array([len(x) // 4 for x in cuts], pa.int64()), pa.array(map(zlib.crc32, cuts), pa.int64()), pa.array(totals, pa.int64())]
                if with_ids:
                    columns.append(pa.array([squeezed(narrow(x)) for x in cuts], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [x.name for x in fields])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, T.StructType(fields))


class OpenWindows:
    """Open windows by remaining room: a segment tree whose leaves are capacities."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.any = [False] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(self.size)]

    def put(self, room: int, name: int) -> None:
        self.at[room].append(name)
        i = self.size + room
        while i and not self.any[i]:
            self.any[i] = True
            i //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, name) of a window with the least room of at least need, which is open no more; None if there is none."""
        i, found = self.size + need, self.any
        if not found[i]:
            while i > 1 and (i % 2 or not found[i + 1]):
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if found[2 * i] else 2 * i + 1
        room = i - self.size
        name = self.at[room].pop()
        if not self.at[room]:
            found[i] = False
            while i > 1 and not found[i ^ 1]:
                i //= 2
                found[i] = False
        return room, name


def best_fit(lengths: list[int], window: int, windows: OpenWindows, used: int) -> tuple[list[int], list[int], int]:
    """(window number, offset) of each length in turn, and how many windows are in use after them."""
    numbers, offsets = [], []
    for n in lengths:
        if (fit := windows.take(n) if n < window else None) is None:
            fit = window, used
            used += 1
        room, name = fit
        numbers.append(name)
        offsets.append(window - room)
        if room > n:
            windows.put(room - n, name)
    return numbers, offsets, used


def pack_pieces(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """pieces with sequence_id and offset (long), ids as array<int>; pieces must be a stored table, which is read twice."""
    total = pieces.agg(F.sum("length"), F.count("*")).first()
    groups = max(1, -(-(total[0] or 0) // (window * GROUP_WINDOWS)), -(-total[1] // GROUP_PIECES))
    names = pieces.columns
    group = F.pmod(F.xxhash64("start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups))
    dealt = pieces.withColumn("group", group).repartition(groups, "group").sortWithinPartitions("group", F.desc("length"), "ids_crc32", "start", "id")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        group, windows, used = None, None, 0
        for batch in batches:
            groups, lengths = batch.column("group").to_numpy(), batch.column("length").to_numpy()
            edges = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1).tolist(), len(groups)]
            numbers, offsets = [], []
            for low, high in zip(edges, edges[1:]):
                if low < high and groups[low] != group:
                    group, windows, used = groups[low], OpenWindows(window), 0
                found, at, used = best_fit(lengths[low:high].tolist(), window, windows, used)
                numbers += [(int(group) << 40) + x for x in found]
                offsets += at
            columns = [widened(pa.array(map(unsqueezed, batch.column(x).to_pylist()), pa.binary()), lengths) if x == "ids" else batch.column(x) for x in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64())], [*names, "sequence_id", "offset"])

    kept = [T.StructField("ids", T.ArrayType(T.IntegerType())) if x.name == "ids" else x for x in pieces.schema.fields]
    schema = T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return dealt.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False, remembered: int | None = None) -> DataFrame:
    """One row per piece with its place: (id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset).

    remembered: words whose ids a Python worker keeps, memory against time; REMEMBERED by default.
    """
    return pack_pieces(settle(token_pieces(docs, tokenizer, id_col, text_col, window, end_id, with_ids, remembered), "pieces"), window)
