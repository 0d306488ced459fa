"""Language identification, words first, then ever shorter character n-grams.

Training counts the words of every labelled text, and the character n-grams of the
words from those counts. Words and n-grams above a rate make the model, so its size
is bounded by the rate and the number of languages, however large the corpus. A
word the model knows is scored by its log frequency in each language; of any other
word each position is scored by the longest n-gram there that the model knows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrier.llm.common import slices
from terrier.session import staged

#: Share of a language's words (n-grams) from which one enters the model: at most 200,000 a language.
RATE = 5e-6
#: Longest n-gram, counting the marks of a word's start and end.
LONGEST = 4
#: What a count that a language lacks counts as.
UNSEEN = 0.5
#: Runs of word characters without digits: letters, and numbers that are no digits (½, ², Ⅷ).
RUNS = re.compile(r"[^\W\d_]+")
COUNT_ENTRIES, MEMO_ENTRIES = 200_000, 300_000
UNKNOWN = "und"


def words_in(chunk: str) -> list[str]:
    """Runs of letters of a lower-case stretch without white space."""
    if chunk.isalpha():
        return [chunk]
    runs = RUNS.findall(chunk)
    if all(map(str.isalpha, runs)):
        return runs
    return "".join(c if c.isalpha() else " " for c in " ".join(runs)).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}

    def counted() -> pa.RecordBatch:
        rows = []
        for lang, chunks in held.items():
            words: Counter = Counter()
            for chunk, n in chunks.items():
                for word in words_in(chunk):
                    words[word] += n
            rows += [(lang, w, n) for w, n in words.items()]
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
             pa.array([r[2] for r in rows], pa.int64())], ["lang", "word", "n"])
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            held.setdefault(lang.as_py(), Counter()).update(text.as_py().lower().split())
            if sum(map(len, held.values())) >= COUNT_ENTRIES:
                yield counted()
    if held:
        yield counted()


def _frequent(counts: DataFrame, item: str) -> tuple[dict[str, float], DataFrame]:
    """Totals by language, and the counts of all items that reach ``RATE`` in some language."""
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # one a language
    least = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, RATE * n)]) if totals else None
    if least is None:
        return totals, counts
    chosen = counts.filter(F.col("n") >= least[F.col("lang")]).select(item).distinct()
    return totals, counts.join(chosen, item)


class Model:
    """Log frequencies of words and n-grams by language."""

    def __init__(self, languages: list[str], words: dict[str, int], word_scores: np.ndarray,
                 grams: dict[str, int], gram_scores: np.ndarray) -> None:
        self.languages = languages
        self.words, self.word_scores = words, word_scores
        self.grams, self.gram_scores = grams, gram_scores

    def grams_of(self, word: str) -> list[int]:
        """At each position of the marked word the longest known n-gram."""
        marked, find, found = f"^{word}$", self.grams.get, []
        for i in range(len(marked) - 1):
            for k in range(min(LONGEST, len(marked) - i), 0, -1):
                gram = find(marked[i: i + k])
                if gram is not None:
                    found.append(gram)
                    break
        return found

    def score(self, words: list[str]) -> np.ndarray:
        """Log likelihood of each word in each language, up to what the languages share.

        A known word has its own; any other has the mean of its n-grams, 0 without one.
        """
        out = np.zeros((len(words), len(self.languages)))
        known = np.array([self.words.get(w, -1) for w in words], np.int64)
        out[known >= 0] = self.word_scores[known[known >= 0]]
        grams = {i: found for i in np.flatnonzero(known < 0).tolist() if (found := self.grams_of(words[i]))}
        if grams:
            sizes = np.array([len(g) for g in grams.values()])
            flat = np.fromiter(chain.from_iterable(grams.values()), np.int64, int(sizes.sum()))
            sums = np.add.reduceat(self.gram_scores[flat], np.cumsum(sizes) - sizes, axis=0)
            out[list(grams)] = sums / sizes[:, None]
        return out


def _table(counts: DataFrame, item: str, languages: list[str], totals: dict[str, float]) -> tuple[dict[str, int], np.ndarray]:
    """Index of items and their log frequencies, as a matrix; bounded by ``RATE``."""
    index: dict[str, int] = {}
    column = {lang: i for i, lang in enumerate(languages)}
    rows, columns, values = [], [], []
    for r in counts.toLocalIterator():
        rows.append(index.setdefault(r[item], len(index)))
        columns.append(column[r.lang])
        values.append(r.n)
    table = np.full((len(index), len(languages)), UNSEEN)
    table[rows, columns] = values
    return index, np.log(table / np.array([totals[lang] + 1.0 for lang in languages]))


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model of all rows with a text and a language; others are left out."""
    labelled = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter(
        "lang IS NOT NULL AND text IS NOT NULL")
    words = staged(labelled.mapInArrow(_count, "lang string, word string, n long")
                   .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    marked = F.concat(F.lit("^"), "word", F.lit("$"))
    windows = words.select("lang", "n", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substr(marked, i, F.lit(LONGEST)))).alias("gram"))
    # a shorter n-gram is counted by the longest windows that begin with it
    windows = windows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = staged(windows.select("lang", "n", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("gram")), lambda k: F.substr("gram", F.lit(1), k))).alias("gram"))
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals, frequent = _frequent(words, "word")
    languages = sorted(totals)
    starts = {r.lang: r.n for r in grams.filter(F.length("gram") == 1).groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    return Model(languages, *_table(frequent, "word", languages, totals),
                 *_table(_frequent(grams, "gram")[1], "gram", languages, starts))


def identify(docs: DataFrame, model: Model, keep: list[Column | str], text: str = "text") -> DataFrame:
    """``keep`` columns of every row with ``lang_pred`` and ``score`` of its whole text.

    ``score`` is the probability of the language among those learned, all alike at
    first. Null text, text without a letter, or a model without languages: ``und``
    and 0. Ties go to the language that sorts first. The model is broadcast; its
    size is bounded by ``RATE``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*keep, F.col(text).alias("__text"))
    schema = source.drop("__text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        memo: dict[str, int] = {}
        table = np.zeros((1, len(model.languages)))  # row 0: nothing to score

        def learn(chunks: list[str]) -> None:
            """Rows of the table for new chunks: the sums of their words."""
            nonlocal table
            cut = [words_in(c) for c in chunks]
            sizes = np.array([len(ws) for ws in cut], np.int64)
            some = sizes > 0
            memo.update(zip(chunks, np.where(some, len(table) - 1 + np.cumsum(some), 0).tolist()))
            if some.any():
                scores = model.score(list(chain.from_iterable(cut)))
                table = np.concatenate([table, np.add.reduceat(scores, (np.cumsum(sizes) - sizes)[some], axis=0)])

        for batch in batches:
            for run, texts in slices(batch):
                if len(memo) > MEMO_ENTRIES:
                    memo, table = {}, table[:1]
                chunks = [t.lower().split() for t in texts]
                learn(list(set().union(*chunks).difference(memo)))
                names, scores = [], []
                for each in chunks:
                    rows = np.fromiter(map(memo.__getitem__, each), np.int64, len(each))
                    if not rows.any() or not model.languages:
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    total = table[rows].sum(axis=0)
                    best = int(total.argmax())
                    names.append(model.languages[best])
                    scores.append(float(1.0 / np.exp(np.minimum(total - total[best], 0.0)).sum()))
                yield pa.RecordBatch.from_arrays(
                    run.columns[:-1] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    run.schema.names[:-1] + ["lang_pred", "score"])
    return source.mapInArrow(predict, schema)
