"""The trie of conversation prefixes, named by doubling.

Level 0 gives every distinct turn a dense number; level k + 1 numbers the distinct pairs of neighbouring blocks of 2**k turns, at
multiples of 2**(k + 1), so all levels together hold twice as many rows as there are turns. A prefix of d turns is then named by the
blocks of d's binary digits, greatest first: one join with each level extends all prefixes whose digit is set. Prefixes are named by
their smallest member at their depth, which is unique there. So a conversation of n turns takes 2 log n rounds of joins, and no row
holds a conversation or the members of a node. Sums over subtrees are sums along conversations: a node's smallest member passes
through all nodes above it.

Keys that a third of all conversations share (a common first turn, a common conversation) are counted before they are shuffled, and
joined with tables of distinct keys on shuffles of their own, which adaptive execution can split. Turns of one long conversation are
numbered by partition (with_places), and sums along it are cut into runs of RUN turns.

Edge cases (tests/llm/test_trie.py): turns are ordered by turn, null first, and equal turns by the SHA-256 of their role and text; null
roles and texts are empty; rows without a conv_id belong to no conversation; repeated rows are turns of their own; a table without
conversations gives no nodes, conversations without turns give the root; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lectern.operators.history import with_places
from lectern.session import forget, settle

#: Turns of a run of one conversation that is summed at a time; conversation ids of a row that is hashed.
RUN, PIECE = 1024, 4096
WORD = r"[^\x20\x09-\x0D]+"


def turn_keys(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, key binary, weight): turns in order from 0; equal keys are equal turns, the weight is the number of words of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), key.alias("key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("weight"))
    placed = with_places(rows.where("conv IS NOT NULL").orderBy("conv", F.asc_nulls_first("turn"), "key"))
    first = placed.groupBy("conv").agg(F.min("place").alias("first"))
    return _split_join(placed, first, "conv").select("conv", (F.col("place") - F.col("first")).alias("pos"), "key", "weight")


def _split_join(rows: DataFrame, named: DataFrame, *key: str) -> DataFrame:
    """rows with the columns of named, which has one row for each key; on complements, so that hot keys of rows can be split."""
    other = named.select(*[F.bitwise_not(k).alias(f"other {k}") for k in key], *[c for c in named.columns if c not in key])
    return rows.join(other, [F.bitwise_not(k) == F.col(f"other {k}") for k in key]).drop(*[f"other {k}" for k in key])


def _named(rows: DataFrame, *key: str) -> DataFrame:
    """rows, a stored table, with a dense `name` for each distinct key instead of it."""
    names = with_places(rows.select(*key).distinct()).withColumnRenamed("place", "name")
    return rows.join(names, list(key)).drop(*key)


def blocks_of_turns(steps: DataFrame, levels: int) -> list[DataFrame]:
    """Stored tables (conv, j, name), one a level: names of the blocks of 2**level turns that begin at j * 2**level."""
    tables = [settle(_named(steps.select("conv", F.col("pos").alias("j"), "key"), "key"), "blocks")]
    while len(tables) < levels:
        half = tables[-1].groupBy("conv", F.shiftright("j", 1).alias("j"))
        pairs = half.agg(F.min_by("name", "j").alias("a"), F.max_by("name", "j").alias("b"), F.count("*").alias("n")).where("n = 2").drop("n")
        pairs = settle(pairs, "pairs")
        tables.append(settle(_named(pairs, "a", "b"), "blocks"))
        forget(pairs)
    return tables


def prefixes(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, depth, node) for every prefix of every conversation: node is the smallest conversation with that prefix."""
    root, longest = convs.agg(F.min("conv"), F.max("length")).first()
    tables = [convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(root).cast("long").alias("node"))]
    levels = blocks_of_turns(steps, (longest or 0).bit_length()) if longest else []
    for k in range(len(levels) - 1, -1, -1):
        even = levels[k].where("j % 2 = 0").select("conv", F.shiftleft("j", k).alias("depth"), "name")
        longer = reduce(DataFrame.unionByName, tables).join(even, ["conv", "depth"])
        longer = settle(longer.withColumn("depth", F.col("depth") + (1 << k)), "longer")
        least = longer.groupBy("depth", "node", "name").agg(F.min("conv").alias("least"))
        named = _split_join(longer, least, "depth", "node", "name")
        tables.append(settle(named.select("conv", "depth", F.col("least").alias("node")), "prefixes"))
        forget(longer, levels[k])
    return reduce(DataFrame.unionByName, tables)


def _suffix_sums(rows: DataFrame, *names: str) -> DataFrame:
    """Sums of columns over this and all greater depths of the conversation, in runs of RUN."""
    runs = rows.withColumn("run", F.floor(F.col("depth") / RUN))
    later = Window.partitionBy("conv").orderBy(F.desc("run")).rowsBetween(Window.unboundedPreceding, -1)
    beyond = runs.groupBy("conv", "run").agg(*[F.sum(c).alias(c) for c in names])
    beyond = beyond.select("conv", "run", *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"later {c}") for c in names])
    within = Window.partitionBy("conv", "run").orderBy(F.desc("depth"))
    return runs.join(beyond, ["conv", "run"]).withColumns({c: F.sum(c).over(within) + F.col(f"later {c}") for c in names})


def digests_of_ends(ends: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256) of (node, depth, conv): SHA-256 of the conversations in ascending order, joined by commas.

    Conversations are put in order by range, joined in pieces of PIECE, and only pieces come together at their node, one after another.
    """

    def pieces(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            node, depth, conv = (batch.column(x).to_numpy() for x in ("node", "depth", "conv"))
            new = np.flatnonzero(np.concatenate(([True], (node[1:] != node[:-1]) | (depth[1:] != depth[:-1])))).tolist()
            cuts = [(x, min(x + PIECE, high)) for low, high in zip(new, [*new[1:], len(node)]) for x in range(low, high, PIECE)]
            at = [low for low, _ in cuts]
            joined = [",".join(map(str, conv[low:high].tolist())) for low, high in cuts]
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(depth[at]), pa.array(conv[at]), pa.array(joined, pa.string())], ["node", "depth", "first", "piece"])

    def hashed(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        at, digest, done = None, None, []
        for batch in batches:
            for node, depth, piece in zip(*(batch.column(x).to_pylist() for x in ("node", "depth", "piece"))):
                if (node, depth) != at:
                    if at:
                        done.append((*at, digest.hexdigest()))
                    at, digest = (node, depth), hashlib.sha256(piece.encode())
                else:
                    digest.update(b"," + piece.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["node", "depth", "ends_sha256"])
                done = []
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, digest.hexdigest())], ["node", "depth", "ends_sha256"])

    ordered = ends.select("node", "depth", "conv").orderBy("depth", "node", "conv")
    parts = ordered.mapInArrow(pieces, "node long, depth long, first long, piece string")
    return parts.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(hashed, "node long, depth long, ends_sha256 string")


def prefix_trie(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """A row a node: (node, depth, parent, n_convs, n_children, n_leaves, saved, ends_sha256).

    steps are (conv, pos from 0, key binary, weight), convs (conv, length), turnless ones included; both should be stored tables.
    saved sums over the subtree, for each node, its last turn's weight times its members but one.
    """
    rows = prefixes(steps, convs)
    counts = rows.groupBy("depth", "node").agg(F.count("*").alias("n_convs"))
    at = lambda df: df.withColumnRenamed("conv", "node")
    last = at(steps.select("conv", (F.col("pos") + 1).alias("depth"), "weight"))
    above = at(rows.select("conv", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent")))
    nodes = settle(counts.join(last, ["node", "depth"], "left").join(above, ["node", "depth"], "left"), "nodes")
    children = nodes.where("parent IS NOT NULL").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["node", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = settle(nodes, "nodes")
    own = nodes.select(F.col("node").alias("conv"), "depth", (F.coalesce("weight", F.lit(0)) * (F.col("n_convs") - 1)).alias("saved"), (F.col("n_children") == 0).cast("long").alias("n_leaves"))
    along = rows.join(own, ["conv", "depth"], "left").fillna(0, ["saved", "n_leaves"])
    sums = _suffix_sums(along, "saved", "n_leaves").groupBy("node", "depth").agg(F.sum("saved").alias("saved"), F.sum("n_leaves").alias("n_leaves"))
    ends = rows.join(convs.select("conv", F.col("length").alias("depth")), ["conv", "depth"])
    found = nodes.join(sums, ["node", "depth"]).join(digests_of_ends(ends), ["node", "depth"], "left")
    empty: Column = F.sha2(F.lit(""), 256)
    return found.select("node", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", F.coalesce("ends_sha256", empty).alias("ends_sha256"))
