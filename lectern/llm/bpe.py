"""Encoding of texts with a BPE tokenizer by a table of distinct words, and decoding through a table of pieces.

Texts are split at white space in blocks of about BLOCK characters. A block keeps its texts as codes, places in the block's own list of
distinct words (letters lower-cased and the signs after them are words apart). The lists of all blocks are dealt to buckets by the
words' hashes: a bucket sees every block's share of its words, encodes each distinct word once, and sends the ids back by block and
place. A word comes once from each block however often texts repeat it, so no word is a hot key, and no shuffle holds one row a word.
Decoding joins the distinct ids of each block with the tokenizer's (id, piece) table, whose size is that of the vocabulary.

Only tokenizers that go by words are split (packing.goes_by_words() reads the tokenizer's own file); of others a whole text is one word.

Edge cases (tests/llm/test_bpe.py): null and empty texts, and those of white space, have no ids and decode to the empty text; repeated
rows are encoded as often as they occur; a null id is kept; special tokens inside a text are found as the tokenizer finds them; ids
outside the vocabulary decode to nothing; an empty table gives no rows; other columns are ignored. A text longer than BLOCK is a block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.packing import LETTERS, SIGNS, goes_by_words
from lectern.session import forget, settle, settle_parts

#: Characters of a block of texts, and ids of a block of token lists.
BLOCK, BLOCK_IDS = 14_000_000, 2_000_000
#: Words of all blocks that a bucket gets, about.
BUCKET_WORDS = 400_000
#: Texts that a worker hands back at a time.
TEXTS = 500

_TOKENIZERS: dict = {}


def tokenizer_at(path: str):
    """(tokenizer without padding or truncation, whether it goes by words), once a process."""
    import json

    from tokenizers import Tokenizer

    if path not in _TOKENIZERS:
        full = Tokenizer.from_file(path)
        full.no_padding(), full.no_truncation()
        _TOKENIZERS[path] = full, goes_by_words(json.loads(full.to_str()))
    return _TOKENIZERS[path]


def squeezed(numbers) -> bytes:
    """Numbers below 2**32, compressed: a byte for each, 255 for those that are more, and what these are more, byte by byte of all of them.

    So small numbers, which codes of frequent words are, take little room.
    """
    import numpy as np
    import zstandard

    numbers = np.asarray(numbers).astype(np.int64)
    small = np.minimum(numbers, 255).astype(np.uint8)
    more = (numbers[small == 255] - 255).astype("<u4").view(np.uint8).reshape(-1, 4).T
    parts = [zstandard.compress(np.ascontiguousarray(x).tobytes(), 3) for x in (small, *more)]
    return b"".join(len(x).to_bytes(8, "little") + x for x in parts)


def unsqueezed(data: bytes):
    import numpy as np
    import zstandard

    parts, at = [], 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        parts.append(np.frombuffer(zstandard.decompress(data[at + 8 : at + 8 + size]), np.uint8))
        at += 8 + size
    numbers = parts[0].astype(np.uint32)
    numbers[parts[0] == 255] += np.ascontiguousarray(np.stack(parts[1:], axis=1)).view("<u4").ravel()
    return numbers


def unsqueezed_words(data: bytes, lengths: bytes) -> list[str]:
    """The words of packed_words()."""
    import zstandard

    text, low, out = zstandard.decompress(data).decode(), 0, []
    for n in unsqueezed(lengths).tolist():
        out.append(text[low : low + n])
        low += n
    return out


def packed_words(words: list[str]) -> tuple[bytes, bytes]:
    """Words, and their lengths in code points."""
    import zstandard

    return zstandard.compress("".join(words).encode(), 3), squeezed([len(w) for w in words])


def gathered(first, count, codes):
    """For codes in turn, first[c], first[c] + 1, ... of count[c] numbers each."""
    import numpy as np

    size = count[codes]
    return np.repeat(first[codes] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class BlockOfTexts:
    """Codes of texts and the distinct words that they stand for."""

    def __init__(self, by_words: bool):
        import re

        self.by_words, self.plain = by_words, re.compile(f"[{LETTERS}]+").fullmatch
        self.at: dict[str, int] = {}
        self.codes, self.sizes, self.chars = [], [], 0

    def add(self, text: str) -> None:
        import numpy as np

        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if self.by_words else [text]
        at = self.at
        for w in set(words).difference(at):
            at[w] = len(at)
        self.codes.append(np.fromiter(map(at.__getitem__, words), np.uint32, len(words)))
        self.chars += len(text)

    def finish(self):
        """(codes, codes of each text, words): words are numbered by how often they occur."""
        import numpy as np

        symbols: dict[str, int] = {}
        parts, counts = [], []
        for w in self.at:
            stem = w.rstrip(SIGNS).lower() if self.by_words else ""
            if self.plain(stem):
                found = [stem, w[len(stem) :]]
            else:
                found = [w]
            found = [symbols.setdefault(x, len(symbols)) for x in found if x]
            parts += found
            counts.append(len(found))
        parts, counts = np.array(parts, np.int64), np.array(counts, np.int64)
        first = np.cumsum(counts) - counts
        raw = np.concatenate(self.codes).astype(np.int64)
        ends = np.cumsum([len(x) for x in self.codes])
        done = np.concatenate(([0], np.cumsum(counts[raw])))[ends]
        codes = parts[gathered(first, counts, raw)]
        order = np.argsort(-np.bincount(codes, minlength=len(symbols)), kind="stable")
        rank = np.empty(len(symbols), np.int64)
        rank[order] = np.arange(len(symbols))
        names = list(symbols)
        return rank[codes], np.diff(done, prepend=0), [names[i] for i in order.tolist()]


def coded_blocks(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, block_chars: int) -> DataFrame:
    """(part, block, ids, sizes, codes, n_words, words, lengths): of each block a row of its texts as codes, and a row of its distinct words."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("part", T.StringType()), T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("sizes", T.BinaryType()), T.StructField("codes", T.BinaryType()), T.StructField("n_words", T.LongType()), T.StructField("words", T.BinaryType()), T.StructField("lengths", T.BinaryType())])

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        by_words = tokenizer_at(tokenizer)[1]
        number, block, ids = TaskContext.get().partitionId() << 32, BlockOfTexts(by_words), []

        def finished():
            codes, sizes, words = block.finish()
            column = pa.concat_arrays(ids)
            listed = pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), column)
            text, lengths = packed_words(words)
            listed = pa.concat_arrays([listed, pa.nulls(1, listed.type)])
            columns = [pa.array(["codes", "words"]), pa.array([number] * 2, pa.int64()), listed, *(pa.array([x, None], pa.binary()) for x in (squeezed(sizes), squeezed(codes))), pa.array([None, len(words)], pa.int64()), *(pa.array([None, x], pa.binary()) for x in (text, lengths))]
            return pa.RecordBatch.from_arrays(columns, schema.names)

        for batch in batches:
            low = 0
            for i, text in enumerate(batch.column(1)):
                block.add(text.as_py() or "")
                if block.chars >= block_chars:
                    ids.append(batch.column(0).slice(low, i + 1 - low))
                    yield finished()
                    number, block, ids, low = number + 1, BlockOfTexts(by_words), [], i + 1
            if low < batch.num_rows:
                ids.append(batch.column(0).slice(low))
        if ids:
            yield finished()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def dealt_words(blocks: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, places, words, lengths): each block's words of each bucket."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for block, words, lengths in zip(*(batch.column(x) for x in ("block", "words", "lengths"))):
                words = unsqueezed_words(words.as_py(), lengths.as_py())
                bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), np.int64, len(words))
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist()
                rows = []
                for low, high in zip(cuts, [*cuts[1:], len(order)]):
                    at = order[low:high]
                    rows.append((block.as_py(), int(bucket[at[0]]), squeezed(at), *packed_words([words[i] for i in at.tolist()])))
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["block", "bucket", "places", "words", "lengths"])

    return blocks.select("block", "words", "lengths").mapInArrow(run, "block long, bucket long, places binary, words binary, lengths binary")


def encoded_words(dealt: DataFrame, tokenizer: str) -> DataFrame:
    """(block, places, counts, ids, distinct): ids of each block's words of a bucket, each distinct word of the bucket encoded once."""
    columns = "block long, places binary, counts binary, ids binary, distinct array<int>"

    def encode(table):
        import numpy as np
        import pyarrow as pa

        full, _ = tokenizer_at(tokenizer)
        lists = [unsqueezed_words(w.as_py(), n.as_py()) for w, n in zip(table.column("words"), table.column("lengths"))]
        at: dict[str, int] = {}
        for words in lists:
            for w in words:
                at.setdefault(w, len(at))
        words, found = list(at), []
        for low in range(0, len(words), 20_000):
            found += [x.ids for x in full.encode_batch_fast(words[low : low + 20_000], add_special_tokens=False)]
        count = np.array([len(x) for x in found], np.int64)
        first, flat = np.cumsum(count) - count, np.array([i for x in found for i in x], np.int64)
        rows = []
        for block, places, words in zip(table.column("block"), table.column("places"), lists):
            codes = np.fromiter((at[w] for w in words), np.int64, len(words))
            ids = flat[gathered(first, count, codes)]
            rows.append((block.as_py(), places.as_py(), squeezed(count[codes]), squeezed(ids), np.unique(ids).tolist()))
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32())]
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["block", "places", "counts", "ids", "distinct"])

    return dealt.groupBy("bucket").applyInArrow(encode, columns)


def pieces_of(spark, tokenizer: str) -> DataFrame:
    """(id, piece) of a tokenizer's vocabulary, special tokens included: as many rows as it has ids."""
    import pandas as pd

    names = tokenizer_at(tokenizer)[0].get_vocab(with_added_tokens=True)
    return spark.createDataFrame(pd.DataFrame({"piece": list(names), "id": list(names.values())}), "piece string, id int")


def block_pieces(distinct: DataFrame, pieces: DataFrame) -> DataFrame:
    """(block, piece_ids, pieces) for (block, distinct): the pieces of a block's ids, as many as the vocabulary has at most."""
    each = distinct.groupBy("block").agg(F.array_distinct(F.flatten(F.collect_list("distinct"))).alias("distinct")).select("block", F.explode("distinct").alias("id"))
    joined = each.join(F.broadcast(pieces), "id").groupBy("block").agg(F.collect_list(F.struct("id", "piece")).alias("found"))
    return joined.select("block", F.col("found.id").alias("piece_ids"), F.col("found.piece").alias("pieces"))


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK, decoded: bool = False) -> DataFrame:
    """(id, ids array<int>[, decoded]) for every row of docs; decoded is the text of its ids.

    Texts decode to their pieces joined by a space, as a tokenizer without a decoder of its own does; others are refused.
    """
    blocks, listed = settle_parts(coded_blocks(docs, tokenizer, id_col, text_col, block_chars), "part", ["codes", "words"], "coded")
    total = listed.agg(F.sum("n_words")).first()[0] or 0
    words = settle(encoded_words(dealt_words(listed, max(1, -(-total // BUCKET_WORDS))), tokenizer), "words")
    forget(listed)
    kind = T.ArrayType(T.IntegerType())
    fields = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("ids", kind)]
    if decoded:
        refuse_decoders(tokenizer)
        fields.append(T.StructField("decoded", T.StringType()))
        more = block_pieces(words, pieces_of(docs.sparkSession, tokenizer))
        words = words.drop("distinct").unionByName(more, allowMissingColumns=True)
    else:
        words = words.drop("distinct")

    def join(texts, found):
        return joined_texts(texts, found, [x.name for x in fields], decoded)

    return blocks.select("block", "ids", "sizes", "codes").groupBy("block").cogroup(words.withColumnRenamed("block", "of").groupBy("of")).applyInArrow(join, T.StructType(fields))


def refuse_decoders(tokenizer: str) -> None:
    if tokenizer_at(tokenizer)[0].decoder is not None:
        raise ValueError("only tokenizers without a decoder of their own, whose pieces are joined by a space, are decoded")


def joined_texts(texts, found, names: list[str], decoded: bool):
    """The texts of one block with the ids of their words, and their pieces."""
    import numpy as np
    import pyarrow as pa

    column, sizes, codes = texts.column("ids").combine_chunks().values, unsqueezed(texts.column("sizes")[0].as_py()), unsqueezed(texts.column("codes")[0].as_py())
    rows = [(unsqueezed(p.as_py()), unsqueezed(c.as_py()), unsqueezed(i.as_py())) for p, c, i in zip(*(found.column(x) for x in ("places", "counts", "ids"))) if p.is_valid]
    places, counts, flat = (np.concatenate(x).astype(np.int64) if rows else np.zeros(0, np.int64) for x in (zip(*rows) if rows else [()] * 3))
    first, count = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    first[places], count[places] = np.cumsum(counts) - counts, counts
    ids = flat[gathered(first, count, codes.astype(np.int64))].astype(np.int32)
    ends = np.cumsum(sizes, dtype=np.int64)
    offsets = np.concatenate(([0], np.concatenate(([0], np.cumsum(count[codes])))[ends])).astype(np.int32)
    out = [column, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))]
    if decoded:
        piece = {}
        for i, p in zip(found.column("piece_ids"), found.column("pieces")):
            if i.is_valid:
                piece.update(zip(i.as_py(), p.as_py()))
        spoken = [" ".join([piece[x] for x in flat[a : a + n].tolist()]) for a, n in zip(first.tolist(), count.tolist())]
        decoded_texts = [" ".join([x for c in codes[a:z].tolist() if (x := spoken[c])]) for a, z in zip([0, *ends.tolist()], ends.tolist())]
        del spoken, piece
        out.append(pa.array(decoded_texts, pa.string()))
    return pa.Table.from_batches(pa.table(out, names=names).to_batches(max_chunksize=TEXTS))


def decode(tokens: DataFrame, tokenizer: str, id_col: str = "id", ids_col: str = "ids", block_ids: int = BLOCK_IDS) -> DataFrame:
    """(id, decoded) for a table of ids: the distinct ids of blocks of rows are joined with the pieces, and read back by block."""
    refuse_decoders(tokenizer)
    kind = tokens.schema[id_col].dataType
    listed = T.ArrayType(T.IntegerType())
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("names", T.ArrayType(kind)), T.StructField("sizes", T.BinaryType()), T.StructField("codes", T.BinaryType()), T.StructField("distinct", listed)])

    def cut(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = batch.column(1).value_lengths().fill_null(0).to_numpy().astype(np.int64)
            block = np.cumsum(sizes) // block_ids
            cuts = np.flatnonzero(np.diff(block, prepend=-1)).tolist()
            for low, high in zip(cuts, [*cuts[1:], len(block)]):
                names, flat = batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low).flatten()
                ids = flat.fill_null(-1).to_numpy().astype(np.int64) & 0xFFFFFFFF
                names = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), pa.concat_arrays([names]))
                known = np.unique(ids[ids < 1 << 31]).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), names, pa.array([squeezed(sizes[low:high])], pa.binary()), pa.array([squeezed(ids)], pa.binary()), pa.array([known], pa.list_(pa.int32()))], schema.names)
                number += 1

    def join(texts, found):
        import pyarrow as pa

        piece = dict(zip(found.column("piece_ids")[0].as_py(), found.column("pieces")[0].as_py())) if found.num_rows else {}
        said, out, low = [piece.get(x) for x in unsqueezed(texts.column("codes")[0].as_py()).tolist()], [], 0
        for n in unsqueezed(texts.column("sizes")[0].as_py()).tolist():
            out.append(" ".join([x for x in said[low : low + n] if x is not None]))
            low += n
        return pa.table([texts.column("names").combine_chunks().values, pa.array(out, pa.string())], names=["id", "decoded"])

    blocks = settle(tokens.select(F.col(id_col).alias("id"), F.col(ids_col).cast(listed).alias("ids")).mapInArrow(cut, schema), "tokens")
    more = block_pieces(blocks, pieces_of(tokens.sparkSession, tokenizer))
    fields = T.StructType([T.StructField("id", kind), T.StructField("decoded", T.StringType())])
    return blocks.drop("distinct").groupBy("block").cogroup(more.withColumnRenamed("block", "of").groupBy("of")).applyInArrow(join, fields)
