"""Ranked lexical search by inverted treaps.

Items are dealt to blocks of about BLOCK_CHARS characters, whose terms every task can hold; documents are read once a block of items.
Each document is counted by its block's terms and stored; document frequencies and lengths are summed over all documents. Tasks then
take shards of documents: every term gets a treap of its postings, a search tree by document and a heap by impact (the term's part of
the score), so the root of any range of documents is the greatest impact in it. All treaps of an item are walked together: a state is
a range of documents with the root of each treap there; the sum of the roots' impacts bounds every score in the range, and a range is
dropped when that sum can't enter the item's best k. Otherwise the document of the greatest root is scored, and the range is split at
it. States of all items are walked in waves of arrays, those of greatest bounds first; lists of the best go on from shard to shard of a
task, and are merged over the tasks as a tree, k rows an item and task.

Impacts that tie are ordered by hashed bits, so treaps over thousands of copies stay shallow. Nothing is cut off: k is the feature.

Edge cases (tests/llm/test_search.py): null and empty texts have no terms, and items without terms no rows; repeated documents rank one
after another, repeated items rank each on its own; ties go to the smaller id, null ids first; ids are whole numbers; a text may be of
any length; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lectern.session import settle

#: Characters of a block of items; postings of a shard of documents; states of a wave; task lists that are merged at a time.
BLOCK_CHARS, SHARD, WAVE, FAN = 4_000_000, 2_000_000, 8192, 64
#: Terms are runs of these bytes once A-Z are lower-cased: digits, letters, and all bytes of characters beyond ASCII.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
NO_ID = -(2**63)


def terms_of(data: bytes) -> list[bytes]:
    return data.translate(TERM_BYTES).split()


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(item, block, id, terms array<binary>) in a stored table: distinct terms, in blocks of about block_chars characters."""
    rows = items.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        row, chars = TaskContext.get().partitionId() << 32, 0
        part = row
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            found, blocks = [list(dict.fromkeys(terms_of(x))) for x in texts], []
            for x in texts:
                chars += len(x)
                blocks.append(part + chars // (block_chars + 1))
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + len(texts)), pa.int64()), pa.array(blocks, pa.int64()), batch.column("id"), pa.array(found, pa.list_(pa.binary()))], ["item", "block", "id", "terms"])
            row += len(texts)

    dealt = rows.repartition(max(1, -(-total // block_chars)))
    return settle(dealt.mapInArrow(run, "item long, block long, id long, terms array<binary>"), "items")


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, terms, counts) of every document: its length in terms, and how often it holds each term of the vocabulary."""

    def run(batches: Iterator) -> Iterator:
        from collections import Counter

        import numpy as np
        import pyarrow as pa

        number = vocabulary.get
        for batch in batches:
            sizes, ends, terms, counts = [], [0], [], []
            for text in batch.column("text").cast(pa.binary()):
                words = terms_of(text.as_py() or b"")
                found = Counter(map(number, words))
                found.pop(None, None)
                sizes.append(len(words))
                terms += found.keys()
                counts += found.values()
                ends.append(len(terms))
            ends = pa.array(np.array(ends, np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.array(x, kind))) for x, kind in ((terms, np.int32), (counts, np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64()), *lists], ["id", "n", "terms", "counts"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, n long, terms array<int>, counts array<long>")


class Treaps:
    """A treap for each term of a shard, in arrays over all postings, which are ordered by term and document."""

    def __init__(self, terms, docs, impacts, n_terms: int):
        import numpy as np

        order = np.lexsort((docs, terms))
        terms, self.doc, self.impact = terms[order], docs[order], impacts[order]
        mixed = (self.doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        self.rank = (self.impact << 20) | (mixed >> np.uint64(44)).astype(np.int64)
        ends = np.searchsorted(terms, np.arange(n_terms), "right")
        ranks, left, right = self.rank.tolist(), [-1] * len(terms), [-1] * len(terms)
        self.root = np.full(n_terms, -1, np.int64)
        low = 0
        for term, high in enumerate(ends.tolist()):
            path: list[int] = []  # the right spine
            for i in range(low, high):
                below, rank = -1, ranks[i]
                while path and ranks[path[-1]] < rank:
                    below = path.pop()
                left[i] = below
                if path:
                    right[path[-1]] = i
                path.append(i)
            if path:
                self.root[term] = path[0]
            low = high
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)

    def within(self, node, low, high):
        """The roots of the parts of subtrees that lie in documents low to high, -1 where there is none."""
        import numpy as np

        node = node.copy()
        live = np.flatnonzero(node >= 0)
        while len(live):
            at = node[live]
            doc = self.doc[at]
            before = doc < low[live]
            out = before | (doc > high[live])
            live, at, before = live[out], at[out], before[out]
            at = np.where(before, self.right[at], self.left[at])
            node[live] = at
            live = live[at >= 0]
        return node


class Best:
    """The k best (score, id) of each item, all in two arrays; ties go to the smaller id."""

    def __init__(self, n: int, k: int):
        import numpy as np

        self.k, self.score, self.id = k, np.zeros((n, k), np.int64), np.full((n, k), np.iinfo(np.int64).max, np.int64)

    def may_enter(self, item, bound, first_id):
        """Whether a score of `bound` of an id of first_id or more could be among an item's best."""
        least = self.score[item, -1]
        return (bound > least) | ((bound == least) & (least > 0) & (first_id < self.id[item, -1]))

    def add(self, item, score, ids) -> None:
        import numpy as np

        ok = self.may_enter(item, score, ids)
        if not ok.any():
            return
        touched, row = np.unique(item[ok], return_inverse=True)
        rows = np.concatenate((np.repeat(np.arange(len(touched)), self.k), row))
        scores, found = np.concatenate((self.score[touched].ravel(), score[ok])), np.concatenate((self.id[touched].ravel(), ids[ok]))
        order = np.lexsort((found, -scores, rows))
        rows = rows[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < self.k
        at = touched[rows[keep]], place[keep]
        self.score[at], self.id[at] = scores[order][keep], found[order][keep]


def search_shard(treaps: Treaps, ids, first, terms, best: Best, wave: int = WAVE) -> None:
    """Put a shard's documents into `best`; ids are ascending, item i asks for terms[first[i]:first[i + 1]]."""
    import numpy as np

    item = np.repeat(np.arange(len(first) - 1), np.diff(first))
    node = treaps.root[terms]
    item, node = item[node >= 0], node[node >= 0]
    items, state = np.unique(item, return_inverse=True)
    #: Pieces of states still to be walked: item, low, high of each state, and (state, node) pairs in order of states.
    stack = [(items, np.zeros(len(items), np.int64), np.full(len(items), len(ids) - 1), state, node)]
    while stack:
        item, low, high, state, node = stack.pop()
        bound = np.bincount(state, treaps.impact[node], len(item)).astype(np.int64)
        good = best.may_enter(item, bound, ids[low])
        if not good.all():
            item, low, high, bound = item[good], low[good], high[good], bound[good]
            keep = good[state]
            state, node = (np.cumsum(good) - 1)[state[keep]], node[keep]
        if not len(item):
            continue
        if len(item) > wave:  # pieces by bound, the greatest on top
            order = np.argsort(bound, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            pairs = np.argsort(place[state], kind="stable")
            state, node = place[state][pairs], node[pairs]
            for a in range(0, len(order), wave):
                some = order[a : a + wave]
                x, z = np.searchsorted(state, (a, a + wave))
                stack.append((item[some], low[some], high[some], state[x:z] - a, node[x:z]))
            continue
        begins = np.searchsorted(state, np.arange(len(item)))
        rank = treaps.rank[node]
        doc = treaps.doc[node]
        top = np.flatnonzero(rank == np.maximum.reduceat(rank, begins)[state])[::-1]
        pivot = np.empty(len(item), np.int64)
        pivot[state[top]] = doc[top]
        at, below, above = pivot[state], low[state], high[state]
        hit = treaps.within(np.where(doc == at, node, np.where(doc < at, treaps.right[node], treaps.left[node])), at, at)
        met = hit >= 0
        score = np.bincount(state[met], treaps.impact[hit[met]], len(item)).astype(np.int64)
        best.add(item, score, ids[pivot])
        left = treaps.within(np.where(doc < at, node, treaps.left[node]), below, at - 1)
        right = treaps.within(np.where(doc > at, node, treaps.right[node]), at + 1, above)
        n = len(item)
        states, nodes = np.concatenate((state, state + n)), np.concatenate((left, right))
        keep = nodes >= 0
        states, nodes = states[keep], nodes[keep]
        lows, highs, items = np.concatenate((low, pivot + 1)), np.concatenate((pivot - 1, high)), np.concatenate((item, item))
        some, states = np.unique(states, return_inverse=True)
        if len(some):
            stack.append((items[some], lows[some], highs[some], states, nodes))


def weight(total: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * total + 2) / (2 * holding + 1)))


def best_of_block(counted: DataFrame, asked: list[list[int]], items: list[int], n_terms: int, k: int, shard: int) -> DataFrame:
    """(item, id, score, part) of the best k of every task, for items whose terms are given by number; counted is a stored table."""
    total, length = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = dict(counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # a row for each term of the block
    weights = [weight(total, holding[t]) if t in holding else 0 for t in range(n_terms)]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        worth = np.array(weights, np.int64)
        used = [[t for t in terms if weights[t] > 0] for terms in asked]
        first, terms = np.concatenate(([0], np.cumsum([len(x) for x in used]))).astype(np.int64), np.array([t for x in used for t in x], np.int64)
        best, held, n_held = Best(len(items), k), [], 0

        def search() -> None:
            ids, sizes, n, found, counts = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            docs = np.repeat(np.arange(len(ids)), sizes)
            long = 100 - 50 + (50 * n * total) // max(length, 1)
            impact = worth[found] * ((1_000_000_000 * counts) // (1000 * counts + 20 * long[docs]))
            some = impact > 0
            if some.any():
                search_shard(Treaps(found[some], place[docs[some]], impact[some], n_terms), ids[order], first, terms, best)

        for batch in batches:
            ids = batch.column("id").fill_null(NO_ID).to_numpy().astype(np.int64)
            sizes = batch.column("terms").value_lengths().to_numpy().astype(np.int64)
            held.append((ids, sizes, batch.column("n").to_numpy(), batch.column("terms").flatten().to_numpy().astype(np.int64), batch.column("counts").flatten().to_numpy()))
            n_held += int(sizes.sum())
            if n_held >= shard:
                search()
                held, n_held = [], 0
        if held:
            search()
        row, at = np.nonzero(best.score > 0)
        ids = best.id[row, at]
        columns = [pa.array(np.array(items, np.int64)[row], pa.int64()), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(best.score[row, at]), pa.array(np.full(len(row), TaskContext.get().partitionId(), np.int32))]
        yield pa.RecordBatch.from_arrays(columns, ["item", "id", "score", "part"])

    return counted.where(F.size("terms") > 0).mapInArrow(run, "item long, id long, score long, part int")


def merged(lists: DataFrame, k: int) -> DataFrame:
    """(item, rank, id, score): lists (item, id, score, part) merged FAN parts at a time."""
    parts = (lists.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        fan = parts > FAN
        lists = lists.withColumn("part", (F.col("part") / FAN).cast("int") if fan else F.lit(0))
        rank = F.row_number().over(Window.partitionBy("item", "part").orderBy(F.desc("score"), F.asc_nulls_first("id")))
        lists = lists.withColumn("rank", rank).where(F.col("rank") <= k)
        if not fan:
            return lists.select("item", "rank", "id", "score")
        lists, parts = lists.drop("rank"), -(-parts // FAN)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS, shard: int = SHARD) -> DataFrame:
    """(item_id, rank, id, score) of the k documents with the highest scores above 0 for each row of items."""
    asked = item_terms(items, item_col, item_text_col, block_chars)
    found = []
    for (block,) in asked.select("block").distinct().orderBy("block").collect():
        rows = asked.where(F.col("block") == block).select("item", "terms").collect()  # about block_chars characters
        vocabulary: dict[bytes, int] = {}
        terms = [[vocabulary.setdefault(bytes(t), len(vocabulary)) for t in r.terms] for r in rows]
        counted = settle(term_counts(docs, vocabulary, id_col, text_col), "counted")
        lists = settle(best_of_block(counted, terms, [r.item for r in rows], len(vocabulary), k, shard), "best")
        found.append(merged(lists, k))
    if not found:
        return asked.select(F.col("id").alias("item_id"), F.lit(0).alias("rank"), "id", F.lit(0).cast("long").alias("score")).limit(0)
    ranked = found[0]
    for more in found[1:]:
        ranked = ranked.unionByName(more)
    return ranked.join(asked.select("item", F.col("id").alias("item_id")), "item").select("item_id", "rank", "id", "score")
