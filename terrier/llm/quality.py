"""Quality by ordinal regression on graded ratings (cumulative logit link).

All grades share one weight per hashed text feature; ordered thresholds cut the
score into grades. The fit gives each document the probability of every grade, so
its expected grade, and the probability of reaching a wanted grade.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrier.session import staged

#: Hashed features, and labelled rows a fit uses at most.
FEATURES, SAMPLE_ROWS = 1 << 18, 12_000
#: Labelled rows a feature must occur in to have a weight; weight decay; steps of the fit.
LEAST_ROWS, DECAY, STEPS = 4, 2e-4, 250
WORDS_KEPT = 500_000
EDGES = re.compile(r"^[^\w]+|[^\w]+$")


class _Features(dict):
    """Feature numbers of words: the bare word and the marks around it."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= WORDS_KEPT:
            self.clear()
        bare = EDGES.sub("", word)
        names = {bare or word}
        if len(word) - len(bare) > 1:  # more than one mark at a word's edges
            names.add("\t" + word.replace(bare, " ") if bare else "\t" + word)
        value = self[word] = tuple(xxhash.xxh3_64_intdigest(n) % FEATURES for n in names)
        return value


def features(text: str | None, known: _Features) -> set[int]:
    """Hashed features present in a whole text: words, marks, length and repetition."""
    words = (text or "").lower().split()
    distinct = set(words)
    found = {f for w in distinct for f in known[w]}
    share = int(10 * len(distinct) / len(words)) if words else 0
    found.add(xxhash.xxh3_64_intdigest(f"\nlength {len(words).bit_length()}") % FEATURES)
    found.add(xxhash.xxh3_64_intdigest(f"\ndistinct {share} {len(words).bit_length()}") % FEATURES)
    return found


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Features()
    for batch in batches:
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([sorted(features(t.as_py(), known)) for t in batch.column(1)],
                                       pa.list_(pa.int32()))], ["grade", "features"])


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Ordinal:
    """Weights and increasing thresholds; P(grade >= k) = logistic(score - threshold k)."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.weights, self.thresholds = weights, thresholds


def fit_ordinal(grades: np.ndarray, starts: np.ndarray, columns: np.ndarray) -> Ordinal:
    """Maximum likelihood with weight decay, by full steps of Adam.

    Row i has the features ``columns[starts[i]:starts[i + 1]]``. Thresholds are kept in
    order by fitting the logarithm of their distances.
    """
    top = int(grades.max()) if len(grades) else 1
    seen = np.bincount(columns, minlength=FEATURES) >= LEAST_ROWS
    rows = np.repeat(np.arange(len(grades)), np.diff(starts))
    rows, columns = rows[seen[columns]], columns[seen[columns]]
    shares = np.array([(grades >= k).mean() if len(grades) else 0.5 for k in range(1, top + 1)])
    first = -np.log(np.clip(shares, 1e-3, 1 - 1e-3) / (1 - np.clip(shares, 1e-3, 1 - 1e-3)))
    gaps = np.log(np.maximum(np.diff(first), 1e-2))
    value = np.concatenate([np.zeros(FEATURES), first[:1], gaps])
    mean, spread = np.zeros_like(value), np.zeros_like(value)
    for step in range(1, STEPS + 1):
        weights = value[:FEATURES]
        cuts = np.cumsum(np.concatenate([value[FEATURES:FEATURES + 1], np.exp(value[FEATURES + 1:])]))
        score = np.bincount(rows, weights[columns], minlength=len(grades))
        bounds = np.concatenate([[-np.inf], cuts, [np.inf]])
        upper = np.where(grades == top, 0.0, _logistic(score - bounds[np.minimum(grades + 1, top)]))
        lower = np.where(grades == 0, 1.0, _logistic(score - bounds[np.maximum(grades, 1)]))
        # P = lower - upper; its logarithm's slopes by score and by both bounding thresholds
        chance = np.maximum(lower - upper, 1e-12)
        d_lower, d_upper = lower * (1 - lower) / chance, upper * (1 - upper) / chance
        by_score = -(d_lower - d_upper) / max(1, len(grades))
        slope = np.zeros_like(value)
        slope[:FEATURES] = np.bincount(columns, by_score[rows], minlength=FEATURES) + DECAY * weights
        by_cut = (np.bincount(np.maximum(grades, 1) - 1, d_lower * (grades > 0), minlength=top)
                  - np.bincount(np.minimum(grades, top - 1), d_upper * (grades < top), minlength=top)) / max(1, len(grades))
        later = np.cumsum(by_cut[::-1])[::-1]
        slope[FEATURES] = later[0]
        slope[FEATURES + 1:] = later[1:] * np.exp(value[FEATURES + 1:])
        mean = 0.9 * mean + 0.1 * slope
        spread = 0.99 * spread + 0.01 * slope ** 2
        value = value - 0.08 * (mean / (1 - 0.9 ** step)) / (np.sqrt(spread / (1 - 0.99 ** step)) + 1e-7)
    cuts = np.cumsum(np.concatenate([value[FEATURES:FEATURES + 1], np.exp(value[FEATURES + 1:])]))
    return Ordinal(value[:FEATURES].astype(np.float32), cuts)


def train(docs: DataFrame, ratings: DataFrame, sample_rows: int = SAMPLE_ROWS, text: str = "text",
          doc_id: str = "doc_id") -> Ordinal:
    """Fit on at most ``sample_rows`` rated documents, drawn by a hash of their ids.

    ``ratings`` has doc_id and grade (0 upwards). Null ids or grades and documents
    without a rating are left out; of several grades of one id the lowest counts.
    Null text counts as empty. Without any rating every document gets probability 0.5.
    """
    rated = (ratings.filter("doc_id IS NOT NULL AND grade IS NOT NULL")
             .groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade")))
    drawn = staged(rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).withColumnRenamed("doc_id", "__id"))
    found = (docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
             .join(F.broadcast(drawn), F.col("doc_id") == F.col("__id"))  # at most sample_rows ids
             .select("grade", "text").mapInArrow(_featurise, "grade int, features array<int>"))
    grades, lists = [], []
    for row in found.toLocalIterator():
        grades.append(row.grade)
        lists.append(np.array(row.features, np.int32))
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return fit_ordinal(np.array(grades, np.int64), starts, np.concatenate(lists or [np.empty(0, np.int32)]))


def _tails(model: Ordinal, texts: pa.Array, known: _Features) -> np.ndarray:
    """Tail probabilities of each text, one row a text."""
    scores = [model.weights[list(features(t.as_py(), known))].sum(dtype=np.float64) for t in texts]
    return _logistic(np.array(scores).reshape(-1, 1) - model.thresholds)


def _reaching(tails: np.ndarray, wanted: int) -> np.ndarray:
    return tails[:, wanted - 1] if wanted <= tails.shape[1] else np.zeros(len(tails))


def rate(docs: DataFrame, model: Ordinal, keep: list[Column | str], wanted: int, text: str = "text") -> DataFrame:
    """``keep`` columns of every row with expected_grade and tail_probability of its whole text.

    ``tail_probability`` is that of grade ``wanted`` or better. Null text counts as empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES numbers
    source = docs.select(*keep, F.col(text).alias("__text"))
    schema = source.drop("__text").withColumns({"expected_grade": F.lit(0.0), "tail_probability": F.lit(0.0)}).schema

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Features()
        for batch in batches:
            tails = _tails(shared.value, batch.column(batch.num_columns - 1), known)
            yield pa.RecordBatch.from_arrays(
                batch.columns[:-1] + [pa.array(tails.sum(axis=1)), pa.array(_reaching(tails, wanted))],
                batch.schema.names[:-1] + ["expected_grade", "tail_probability"])
    return source.mapInArrow(rated, schema)


def select(docs: DataFrame, model: Ordinal, wanted: int, least: float, text: str = "text") -> DataFrame:
    """The rows whose probability of grade ``wanted`` or better is ``least`` or more, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Features()
        for batch in batches:
            chance = _reaching(_tails(shared.value, batch.column(at), known), wanted)
            yield batch.filter(pa.array(chance >= least))
    return docs.mapInArrow(selected, docs.schema)


#: Probability of a good grade from which a document is kept.
KEEP_FROM = 0.5


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade of labels: 0 toxic, 1 of low quality, 2 good; null where that is unknown."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(
        (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 2)
    return labels.select("doc_id", grade.alias("grade"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are likely good, with all their columns."""
    return select(docs, train(docs, graded(labels)), wanted=2, least=KEEP_FROM)
