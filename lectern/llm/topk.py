"""Exact top-k search by inner product: tiles of queries against shards of candidates.

Vectors are scaled to integers, floor(scale * x) with x as a double. Candidates become shards of at most SHARD rows and queries tiles
of at most TILE rows, each one binary matrix; every shard meets every tile of its dimension, one matrix product gives the scores, and
a tile keeps the k best of each query. These short lists are merged again within a task, then over the tasks, k rows a query at most
from each, so no task ever holds the scores of a query against all candidates. Products of floats are exact below 2**53; a tile that
could go beyond is multiplied in Python integers, and scores beyond 64 bits are cut to the range of a long.

Edge cases (tests/llm/test_topk.py): vectors that are null or hold null or non-finite components, and rows with a null id, take no
part; a query meets only vectors of its own dimension; rows that repeat an id are separate candidates, and one query (the query's own
id never is its candidate; of unequal vectors with one id each counts, its lists merged); ties go to the smaller id; fewer candidates
than k give fewer ranks; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from lectern.session import settle

TILE, SHARD, SCALE = 1024, 8192, 256
#: What a task holds of either side at most, and what makes another task worth while; lists are merged so many at a time.
MOST_BYTES, LEAST_BYTES, FAN = 64 << 20, 2 << 20, 64
EXACT = 2**53
BLOCKS = "dim int, n int, ids binary, vectors binary"


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(~F.coalesce(F.exists("v", bad), F.lit(False)))


def _blocks(rows: DataFrame, most: int, scale: int) -> DataFrame:
    """Rows (id, v) as blocks of up to `most` rows of a dimension: ids as int64, scaled vectors as float64, row by row."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        held: dict[int, list] = {}

        def block(dim: int):
            ids, parts = zip(*held.pop(dim))
            ids = np.concatenate(ids)
            matrix = np.floor(scale * np.concatenate(parts).reshape(len(ids), dim))
            columns = [pa.array([dim], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([matrix.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["dim", "n", "ids", "vectors"])

        for batch in batches:
            ids, v = batch.column(0).to_numpy(), batch.column(1)
            ends = v.offsets.to_numpy().astype(np.int64)
            values = v.values.to_numpy()
            dims = np.diff(ends)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                for low in range(0, len(at), most):
                    some = at[low : low + most]
                    taken = values[(ends[some][:, None] + np.arange(dim)).ravel()]
                    held.setdefault(dim, []).append((ids[some], taken))
                    if sum(len(x) for x, _ in held[dim]) >= most:
                        yield block(dim)
        for dim in list(held):
            yield block(dim)

    return rows.mapInArrow(run, BLOCKS)


def best(scores, ids, own, k: int):
    """(row, position) of the k best of each row of scores, ties to the smaller id, without the row's own id."""
    import numpy as np

    scores = np.where(ids[None, :] == own[:, None], -np.inf if scores.dtype == np.float64 else np.iinfo(np.int64).min, scores)
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        row, at = np.nonzero(scores >= least[:, None])
    else:
        row, at = (x.ravel() for x in np.indices(scores.shape))
    keep = ids[at] != own[row]
    row, at = row[keep], at[keep]
    order = np.lexsort((ids[at], -scores[row, at], row))
    row, at = row[order], at[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], at[rank < k]


def products(queries, candidates):
    """Exact inner products of two float64 matrices of whole numbers, as float64 or int64."""
    import numpy as np

    if not queries.size or not candidates.size:
        return np.zeros((len(queries), len(candidates)))
    if np.abs(queries).max() * np.abs(candidates).max() * queries.shape[1] < EXACT:
        return queries @ candidates.T
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(queries).astype(object) @ whole(candidates).astype(object).T
    return np.clip(exact, -(2**63) + 1, 2**63 - 1).astype(np.int64)


def _pair_up(blocks: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
    """Each block once for every group on the other side."""
    dealt = blocks.withColumn(own, F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(n_own)).cast("int"))
    return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))


def _meet(k: int):
    def run(tiles, shards):
        import numpy as np
        import pyarrow as pa

        def matrices(blocks):
            for n, dim, ids, vectors in zip(*(blocks.column(x).to_pylist() for x in ("n", "dim", "ids", "vectors"))):
                yield np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(n, dim)

        out: list = []
        held = list(matrices(shards))
        for own, queries in matrices(tiles):
            rows, found, scores = [], [], []
            for ids, candidates in held:
                product = products(queries, candidates)
                row, at = best(product, ids, own, k)
                rows.append(row), found.append(ids[at]), scores.append(product[row, at].astype(np.int64))
            if not rows:
                continue
            row, ids, score = map(np.concatenate, (rows, found, scores))
            order = np.lexsort((ids, -score, row))
            row, ids, score = row[order], ids[order], score[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append((own[row[keep]], ids[keep], score[keep]))
        columns = [np.concatenate(x) if out else np.array([], np.int64) for x in (zip(*out) if out else ((), (), ()))]
        part = shards.column("part")[0].as_py() if shards.num_rows else 0
        return pa.table([*(pa.array(x, pa.int64()) for x in columns), pa.array([part] * len(columns[0]), pa.int32())], names=["query_id", "id", "score", "part"])

    return run


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(query_id, rank, id, score) of the k candidates with the highest inner products, for the rows of vectors where is_query holds."""
    spark = vectors.sparkSession
    shards = settle(_blocks(_valid(vectors, id_col, vector_col), SHARD, scale), "shards")
    tiles = settle(_blocks(_valid(vectors.where(is_query), id_col, vector_col).distinct(), TILE, scale), "tiles")
    size = lambda blocks: blocks.agg(F.coalesce(F.sum(F.length("vectors") + F.length("ids")), F.lit(0))).first()[0]
    candidates, asked = size(shards), size(tiles)
    parts = max(1, -(-candidates // MOST_BYTES), min(spark.sparkContext.defaultParallelism, -(-candidates // LEAST_BYTES)))
    groups = max(1, -(-asked // MOST_BYTES))
    left = _pair_up(tiles, "tile_group", groups, "part", parts).groupBy("dim", "tile_group", "part")
    right = _pair_up(shards, "part", parts, "tile_group", groups).groupBy("dim", "tile_group", "part")
    lists = left.cogroup(right).applyInArrow(_meet(k), "query_id long, id long, score long, part int")
    while True:
        fan = parts > FAN
        lists = lists.withColumn("part", (F.col("part") / FAN).cast("int") if fan else F.lit(0))
        rank = F.row_number().over(Window.partitionBy("query_id", "part").orderBy(F.desc("score"), "id"))
        lists = lists.withColumn("rank", rank).where(F.col("rank") <= k)
        if not fan:
            return lists.select("query_id", "rank", "id", "score")
        lists, parts = lists.drop("rank"), -(-parts // FAN)
