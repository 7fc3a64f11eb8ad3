"""The prefix trie against plain dictionaries of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from lectern.llm import queries, trie
from lectern.session import settle

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(convs: dict) -> set:
    """convs: {id: [(role, text), ...]}"""
    nodes, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            nodes[tuple(convs[c][:d])].append(c)
        ends[tuple(convs[c])].append(c)
    children, out = defaultdict(int), set()
    for k in nodes:
        if k:
            children[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, own in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(own) - 1) * len(k[-1][1].split()) if k else 0
    for k, own in nodes.items():
        digest = hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
        out.add((own[0], len(k), nodes[k[:-1]][0] if k else None, len(own), children[k], leaves[k], saved[k], digest))
    return out


def rebuilt(rows) -> dict:
    own = defaultdict(list)
    key = lambda r: hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest()
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], -1 if r[1] is None else r[1], key(r))):
        own[r[0]].append((r[2] or "", r[3] or ""))
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - c % 20, [])[: h[c]] + x[h[c] :] for c, x in own.items()}


def nodes_of(found) -> set:
    return {tuple(r) for r in found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()}


def rows_of_many_kinds() -> list:
    rng, rows = random.Random(5), []
    for c in [*range(0, 70), 215, 230, 431, 10**12]:
        for t in range(rng.choice([1, 2, 3, 4, 9, 17])):
            rows.append((c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["hi", "hello there  you", "", None, "a\tb\nc"])))
    rows += [(3, t, "user", "again") for t in range(200)] + [(3, 7, "user", "tie")] * 2 + [(None, 1, "user", "nobody's")]
    rows += [(c, t, "user", f"copied {t}") for c in range(500, 560) for t in range(5)]
    return rows


@pytest.fixture(scope="module")
def small_folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("trie")
    rows = spark.createDataFrame(rows_of_many_kinds(), SCHEMA).selectExpr("*", "1 AS conv", "'x' AS node", "2 AS pos")
    rows.repartition(3).write.parquet(f"{path}/conversations.parquet")
    return str(path)


def test_nodes_equal_brute_force(spark, small_folder):
    assert nodes_of(queries.op12_prefix_trie(spark, small_folder)) == brute({c: [(r, x) for r, x in t] for c, t in rebuilt(rows_of_many_kinds()).items()})


def test_sql_agrees(spark, small_folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{small_folder}/conversations.parquet/*.parquet'")
    assert nodes_of(queries.op12_prefix_trie(spark, small_folder)) == set(con.execute(queries.OP12_SQL).fetchall())


def test_one_long_conversation_and_runs(spark, monkeypatch):
    monkeypatch.setattr(trie, "RUN", 8), monkeypatch.setattr(trie, "PIECE", 3)
    convs = {1: [("u", f"w {i % 3}") for i in range(130)], 2: [("u", f"w {i % 3}") for i in range(100)], 3: [], **{k: [("u", "w 0")] for k in range(4, 30)}}
    rows = [(c, i, r, x) for c, turns in convs.items() for i, (r, x) in enumerate(turns)]
    steps = settle(trie.turn_keys(spark.createDataFrame(rows, SCHEMA)))
    lengths = settle(spark.createDataFrame([(c, len(x)) for c, x in convs.items()], "conv long, length long"))
    got = trie.prefix_trie(steps, lengths)
    assert {tuple(r) for r in got.select("node", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256").collect()} == brute(convs)


def test_no_conversations_and_turnless_ones(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op12_prefix_trie(spark, str(tmp_path)).count() == 0
    steps = settle(trie.turn_keys(spark.createDataFrame([], SCHEMA)))
    lengths = settle(spark.createDataFrame([(7, 0), (5, 0)], "conv long, length long"))
    assert [tuple(r)[:7] for r in trie.prefix_trie(steps, lengths).collect()] == [(5, 0, None, 2, 0, 1, 0)]
