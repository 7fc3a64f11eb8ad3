"""Text quality by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut its score: P(grade > k) is logistic in
score minus threshold k, and the probability of a grade is the difference of those of its two thresholds. The model is fitted by the
likelihood of the grades. Thresholds stay ordered because they are fitted as a first value and positive steps. The result is the
expected grade and the probability of the selection grade or better. With two grades, as here, this is logistic regression.

A text's features are shares: of its token shapes (letters, digits and other signs, runs cut short) and pairs of them, of hashed words,
and of tokens that repeat the token 1 to 8 places before them or have been seen before. A run without white space is cut into tokens of
LONGEST characters: texts of scripts that set no spaces are read as a whole.

Edge cases (tests/llm/test_quality.py): null and empty texts have no features, are scored by the thresholds alone and are rejected
only if the share of low grades says so; without ratings, or with one grade alone, every text is kept; repeated rows and null ids keep
one result each; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.learning import PER_CLASS, adam, fit_in_task, labelled_sample

BUCKETS, LAGS = 1 << 16, 8
STEPS, RATE, SHRINK = 150, 0.1, 1e-5
#: Texts are kept at this probability of the selection grade or better.
KEEP = 0.5
#: Longer runs without white space are cut into tokens of so many characters.
LONGEST = 200
#: Tokens that a Python worker remembers; beyond it starts anew.
REMEMBERED = 150_000


def shape(token: str) -> str:
    """Classes of a token's characters, runs of one class as one or, if longer, two signs."""
    out, last, run = [], "", 0
    for c in token:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        run = run + 1 if k == last else 1
        if run <= 2:
            out.append(k)
        last = k
    return "".join(out)


def pieces(text: str) -> list[str]:
    """A text's tokens: what stands between white space, in pieces of LONGEST characters, so that all of it is read."""
    found = text.split()
    if len(text) <= LONGEST or max(map(len, found), default=0) <= LONGEST:
        return found
    return [x[k : k + LONGEST] for x in found for k in range(0, len(x), LONGEST)]


class Tokens:
    """Tokens by number, with the buckets of their shape and their word."""

    def __init__(self):
        import numpy as np

        self.number: dict[str, int] = {}
        self.shapes, self.words = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def numbers(self, text: str):
        import numpy as np
        from xxhash import xxh32_intdigest

        if len(self.number) > REMEMBERED:
            self.__init__()
        parts, known = pieces(text), self.number
        for x in set(parts).difference(known):
            n = known[x] = len(known)
            if n >= len(self.shapes):
                self.shapes, self.words = (np.concatenate((a, np.zeros_like(a))) for a in (self.shapes, self.words))
            self.shapes[n] = xxh32_intdigest("s" + shape(x))
            self.words[n] = xxh32_intdigest("w" + x.lower())
        return np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))

    def features(self, text: str | None):
        """(buckets, values) of a text."""
        import numpy as np

        numbers = self.numbers(text or "")
        n = len(numbers)
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.float32)
        shapes = self.shapes[numbers]
        buckets = [shapes % BUCKETS, (shapes[:-1] * 31 + shapes[1:] + 7) % BUCKETS, self.words[numbers] % BUCKETS]
        found, values = np.unique(np.concatenate(buckets), return_counts=True)
        lags = np.array([np.count_nonzero(numbers[d:] == numbers[:-d]) if n > d else 0 for d in range(1, LAGS + 1)] + [n - len(np.unique(numbers))])
        return np.concatenate((found, BUCKETS + np.arange(LAGS + 1))).astype(np.int32), (np.concatenate((values, lags)) / n).astype(np.float32)


def _link(x):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(texts: list[str], grades, weights) -> dict:
    """Weights, thresholds and grades, lowest first."""
    import numpy as np

    levels = np.unique(grades)
    size, cuts = BUCKETS + LAGS + 1, max(0, len(levels) - 1)
    if not cuts:
        return {"weights": np.zeros(size), "thresholds": np.zeros(0), "levels": levels if len(levels) else np.zeros(1, np.int64)}
    tokens = Tokens()
    rows = [tokens.features(x) for x in texts]
    starts = np.cumsum([0] + [len(b) for b, _ in rows])
    of_row = np.repeat(np.arange(len(rows)), np.diff(starts))
    buckets, values = (np.concatenate(x) for x in zip(*rows))
    level, each = np.searchsorted(levels, grades), np.arange(len(rows))
    weights = weights / weights.sum()

    def thresholds(tail):
        return np.cumsum(np.concatenate((tail[:1], np.exp(tail[1:]))))

    def gradient(x):
        score = np.bincount(of_row, values * x[buckets], len(rows))
        over = np.ones((len(rows), cuts + 2))  # the chance to be above each threshold, and above none and all of them
        over[:, 1:-1], over[:, -1] = _link(score[:, None] - thresholds(x[size:])), 0
        low, high = over[each, level], over[each, level + 1]
        chance = np.maximum(low - high, 1e-12)
        out = np.bincount(buckets, values * ((low + high - 1) * weights)[of_row], size) + SHRINK * x[:size]
        pull = np.zeros((len(rows), cuts + 2))
        pull[each, level] = low * (1 - low) / chance * weights
        pull[each, level + 1] -= high * (1 - high) / chance * weights
        by_cut = pull[:, 1:-1].sum(0)[::-1].cumsum()[::-1]  # a step moves every threshold from its own on
        return np.concatenate((out, by_cut * np.concatenate(([1.0], np.exp(x[size + 1 :])))))

    x = adam(np.zeros(size + cuts), gradient, STEPS, RATE)
    return {"weights": x[:size], "thresholds": thresholds(x[size:]), "levels": levels}


class Grader:
    def __init__(self, weights, thresholds, levels):
        self.weights, self.thresholds, self.levels, self.tokens = weights, thresholds, levels, Tokens()

    def grade(self, text: str | None) -> tuple[float, list[float]]:
        """Expected grade, and the probability of each grade or better but the lowest."""
        buckets, values = self.tokens.features(text)
        tail = _link(float((self.weights[buckets] * values).sum()) - self.thresholds)
        return float(self.levels[0] + ((self.levels[1:] - self.levels[:-1]) * tail).sum()), tail.tolist()


GRADE = T.StructType([T.StructField("expected_grade", T.DoubleType()), T.StructField("tail", T.ArrayType(T.DoubleType()))])


def keep_texts(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows of docs, as they are, whose chance of the highest grade suffices."""
    name = "graded"
    while name.lower() in {x.lower() for x in docs.columns}:
        name += "_"
    _, keep = selected(F.col(name), model)
    return grade_texts(docs, model, docs.columns, text_col, name).where(keep).select(*docs.columns)


def grade_texts(docs: DataFrame, model: dict, columns: list[str], text_col: str = "text", name: str = "graded") -> DataFrame:
    """docs' columns with graded: struct<expected_grade, tail>."""
    read = docs.select(*columns) if text_col in columns else docs.select(*columns, F.col(text_col).alias("text to grade"))
    at = columns.index(text_col) if text_col in columns else len(columns)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        grader = Grader(**model)
        kind = pa.struct([("expected_grade", pa.float64()), ("tail", pa.list_(pa.float64()))])
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                found = [grader.grade(x) for x in part.column(at).to_pylist()]
                graded = pa.array([{"expected_grade": a, "tail": b} for a, b in found], kind)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], graded], [*columns, name])

    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField(name, GRADE)])
    return read.mapInArrow(run, schema)


def selected(graded: Column, model: dict, grade: int | None = None, keep: float = KEEP) -> tuple[Column, Column]:
    """Probability of `grade` or better (by default the highest grade), and whether it suffices."""
    levels = model["levels"].tolist()
    cut = levels.index(levels[-1] if grade is None else grade)
    chance = F.get(graded["tail"], cut - 1) if cut else F.lit(1.0)
    return chance, chance >= keep


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> dict:
    return fit_in_task(labelled_sample(docs, labels, label_col, id_col, text_col, per_class), fit)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_class: int = PER_CLASS) -> DataFrame:
    """(id, expected_grade, chance, keep) for every row of docs."""
    model = train(docs, labels, id_col, text_col, label_col, per_class)
    found = grade_texts(docs, model, [id_col], text_col)
    chance, keep = selected(F.col("graded"), model)
    return found.select(F.col(id_col).alias("id"), "graded.expected_grade", chance.alias("chance"), keep.alias("keep"))
