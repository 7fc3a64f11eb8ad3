"""Bounded labelled samples, and models that one task fits to them.

A sample is bounded in rows (per_class for each label, and half as many again at most) and in bytes (texts of over TEXT_BYTES do not
enter it); nothing else that is learned or scored is bounded.

Edge cases (tests/llm/test_learning.py): null ids and labels, and null texts, are not learned; of contradictory labels of an id the
largest counts; ids that repeat give a row for each different text, within the bound; without labels the sample is empty; columns of
other names are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import settle

#: Rows of each label that a model is fitted to, about; the only bound on what it learns from.
PER_CLASS = 4000
FOLDS = 5
#: Longer texts are scored, but not learned from: the sample has to fit one task.
TEXT_BYTES = 100_000


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: crc32 of the id as text is divisible by FOLDS. A null id always is."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % FOLDS == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> DataFrame:
    """(text, label int, weight double) of about per_class texts of each label, by hash of the id, outside the held-out fold.

    weight restores the labels' shares. Of contradictory labels of an id the largest counts; equal texts with one id count once.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(~held_out(F.col("id")) & F.col("label").isNotNull() & F.col("id").isNotNull())
    known = settle(known.groupBy("id").agg(F.max("label").alias("label")), "labels")
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # a row for each grade
    if not counts:
        return docs.sparkSession.createDataFrame([], "text string, label int, weight double")
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_class / n))])
    # at most a little over per_class ids of each label: a proven bound for the broadcast
    some = known.withColumn("share", share[F.col("label")]).where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id").where((F.octet_length("text") <= TEXT_BYTES))
    found = found.dropDuplicates(["id", "text"]).select("text", "label", (1 / F.col("share")).alias("weight"), F.xxhash64("id", "text").alias("place"))
    most = per_class * len(counts) * 3 // 2
    return settle(found.orderBy("place", "text").limit(most).drop("place"), "sample")


def fit_in_task(sample: DataFrame, fit: Callable) -> dict:
    """The arrays that fit(texts, labels, weights) returns for a bounded sample, run in one task so that a lost executor only repeats it."""

    def run(frames: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        rows = [x for frame in frames for x in frame.itertuples(index=False, name=None)]
        rows.sort()
        texts, labels, weights = zip(*rows) if rows else ((), (), ())
        blob = io.BytesIO()
        np.savez_compressed(blob, **fit(list(texts), np.array(labels, np.int64), np.array(weights, np.float64)))
        yield pd.DataFrame({"model": [blob.getvalue()]})

    import numpy as np

    blob = sample.select("text", "label", "weight").coalesce(1).mapInPandas(run, "model binary").first()
    with np.load(io.BytesIO(bytes(blob[0]) if blob else _nothing(fit))) as arrays:
        return {k: arrays[k] for k in arrays.files}


def _nothing(fit: Callable) -> bytes:
    import numpy as np

    blob = io.BytesIO()
    np.savez_compressed(blob, **fit([], np.array([], np.int64), np.array([], np.float64)))
    return blob.getvalue()


def adam(start, gradient: Callable, steps: int, rate: float):
    """Minimise from start; gradient(x) gives the gradient at x."""
    import numpy as np

    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, steps + 1):
        g = gradient(x)
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return x
