"""Toxicity by multiple-instance learning: documents have labels, sentences get scores.

A sentence's probability is logistic in the hashed features of its words; a document's is the noisy-or of its sentences, one minus the
product of their complements. The weights are trained from document labels through the noisy-or, so sentences that explain the labels
get high scores by themselves, and these sentences are returned as the offending ones. Words count by themselves and by their first
and last letters, as inflected forms are new words.

Edge cases (tests/llm/test_toxicity.py): null and empty texts have no sentences and score zero; without labels, or with labels of one
kind, every score is the bias alone; repeated rows and null ids keep one result each; an empty table gives no rows; other columns are
never read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.learning import PER_CLASS, adam, fit_in_task, labelled_sample

BUCKETS, FEATURES = 1 << 18, 7
BIAS, STEPS, RATE, SHRINK = -5.0, 120, 0.08, 1e-4
OFFENDING = 0.5
#: Features of fewer documents are not learned.
MIN_DOCS = 8
#: Words that a Python worker remembers; beyond it starts anew.
REMEMBERED = 1_000_000
#: Signs that end a sentence, of several scripts.
ENDS = frozenset(".!?…。！？｡।॥؟۔։።")


def tokens(text: str) -> list[str]:
    return text.replace("\n", " \n ").replace("\t", " ").split(" ")


def is_end(token: str) -> bool:
    return token == "\n" or token[-1:] in ENDS


def features(token: str) -> list[int] | None:
    """Buckets of a token's word, None if it has none; bucket 0 stands for nothing."""
    from xxhash import xxh32_intdigest

    word = token.lower().strip("\r.,;:!?\"'()[]{}<>«»„“”|#$%&*-_+=/\\")
    if not word or word.isdigit():
        return None
    names = [f"w{word}"] + [f"p{word[:n]}" for n in (3, 4, 5, 6) if len(word) >= n] + [f"s{word[-n:]}" for n in (3, 4) if len(word) >= n]
    found = [1 + xxh32_intdigest(x) % (BUCKETS - 1) for x in names]
    return found + [0] * (FEATURES - len(found))


class Words:
    """Tokens by number, with whether each ends a sentence."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.new: list[str] = []

    def numbers(self, text: str):
        import numpy as np

        parts, known = tokens(text), self.number
        for x in set(parts).difference(known):
            known[x] = len(known)
            self.new.append(x)
        return np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))


def _sentences(ends):
    """Where sentences start, for flags of the tokens that end one."""
    import numpy as np

    return np.concatenate(([0], np.flatnonzero(ends[:-1]) + 1))


def _common(rows, flat, doc_starts):
    """Which features of each word occur in at least MIN_DOCS documents."""
    import numpy as np

    docs = np.zeros(BUCKETS, np.int64)
    for part in np.split(flat, doc_starts[1:]):
        docs[np.unique(rows[np.unique(part)])] += 1
    return docs[rows] >= MIN_DOCS


def fit(texts: list[str], labels, weights) -> dict:
    """Weights and bias; labels over zero are toxic."""
    import numpy as np

    words, docs = Words(), []
    for x in texts:
        if x:
            docs.append(words.numbers(x))
    kept = np.array([bool(x) for x in texts], bool)
    labels, weights = labels[kept] > 0, weights[kept]
    start = np.zeros(BUCKETS + 1)
    start[-1] = BIAS
    if not len(docs) or labels.all() or not labels.any():
        return {"weights": start[:-1].astype(np.float32), "bias": start[-1:]}
    rows = np.array([features(x) or [0] * FEATURES for x in words.new], np.int32)
    ends = np.array([is_end(x) for x in words.new])
    flat = np.concatenate(docs)
    doc_starts = np.cumsum([0] + [len(x) for x in docs])[:-1]
    last = ends[flat]
    last[np.append(doc_starts[1:], len(flat)) - 1] = True
    starts = np.concatenate(([0], np.flatnonzero(last[:-1]) + 1))
    lengths = np.diff(np.append(starts, len(flat)))
    of_doc = np.searchsorted(starts, doc_starts)
    sentence_doc = np.repeat(np.arange(len(docs)), np.diff(np.append(of_doc, len(starts))))
    weights = weights / weights.sum()
    rows = np.where(_common(rows, flat, doc_starts), rows, 0)

    def gradient(x):
        score = x[:-1][rows].sum(1)
        z = x[-1] + np.add.reduceat(score[flat], starts)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.exp(np.add.reduceat(-np.logaddexp(0, z), of_doc))
        pull = np.where(labels, -clean / np.maximum(1 - clean, 1e-12), 1.0) * weights
        g = p * pull[sentence_doc]
        by_word = np.bincount(flat, np.repeat(g, lengths), len(rows))
        out = np.bincount(rows.ravel(), np.repeat(by_word, FEATURES), BUCKETS)
        out += SHRINK * x[:-1]
        out[0] = 0
        return np.append(out, g.sum())

    x = adam(start, gradient, STEPS, RATE)
    return {"weights": x[:-1].astype(np.float32), "bias": x[-1:]}


class Scorer:
    """Scores texts with a fitted model, remembering what words are worth."""

    def __init__(self, weights, bias):
        import numpy as np

        self.weights, self.bias = np.asarray(weights, np.float64), float(np.asarray(bias).ravel()[0])
        self._forget()

    def _forget(self) -> None:
        import numpy as np

        self.words, self.worth, self.ends = Words(), np.zeros(1 << 12), np.zeros(1 << 12, bool)

    def _learn(self) -> None:
        import numpy as np

        new, total = self.words.new, len(self.words.number)
        while total > len(self.worth):
            self.worth, self.ends = np.concatenate((self.worth, np.zeros_like(self.worth))), np.concatenate((self.ends, np.zeros_like(self.ends)))
        rows = np.array([features(x) or [0] * FEATURES for x in new], np.int32)
        self.worth[total - len(new) : total] = self.weights[rows].sum(1)
        self.ends[total - len(new) : total] = [is_end(x) for x in new]
        self.words.new = []

    def score(self, text: str | None) -> tuple[float, list[dict]]:
        """Probability of a document, and its offending sentences with theirs."""
        import numpy as np

        if not text:
            return 0.0, []
        if len(self.words.number) > REMEMBERED:
            self._forget()
        numbers = self.words.numbers(text)
        if self.words.new:
            self._learn()
        starts = _sentences(self.ends[numbers])
        z = self.bias + np.add.reduceat(self.worth[numbers], starts)
        bad = np.flatnonzero(z >= np.log(OFFENDING / (1 - OFFENDING)))
        found = []
        if len(bad):
            parts, stops = tokens(text), np.append(starts[1:], len(numbers))
            found = [{"sentence": " ".join(parts[starts[i] : stops[i]]).strip(), "score": float(1 / (1 + np.exp(-z[i])))} for i in bad.tolist()]
        return float(-np.expm1(-np.logaddexp(0, z).sum())), found


SCHEMA = [T.StructField("score", T.DoubleType()), T.StructField("offending", T.ArrayType(T.StructType([T.StructField("sentence", T.StringType()), T.StructField("score", T.DoubleType())])))]


def score_documents(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, offending array<struct<sentence, score>>) for every row of docs."""
    weights, bias = model["weights"], model["bias"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = Scorer(weights, bias)
        kind = pa.list_(pa.struct([("sentence", pa.string()), ("score", pa.float64())]))
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                found = [scorer.score(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in found], pa.float64()), pa.array([x for _, x in found], kind)], ["id", "score", "offending"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *SCHEMA])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = PER_CLASS) -> DataFrame:
    """Fit on labelled documents outside the held-out fold, and score all documents."""
    model = fit_in_task(labelled_sample(docs, labels, label_col, id_col, text_col, per_class), fit)
    return score_documents(docs, model, id_col, text_col)
