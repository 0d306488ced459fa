"""Phrases of two to four words that stick together, by vertical partitioning of suffixes.

The suffixes of all pieces, cut at four words, make one tree by language, and the count of
a phrase is the total of the leaves below its node. The tree is never built as a whole:

* Prefixes of one word and of two words are counted by one pass over the texts each. Below
  a prefix seen less than ``LEAST`` times no phrase can count, so its suffixes are cut there.
* What is left, two-word prefixes, is packed into groups of ``BUDGET`` suffixes at most. A
  prefix larger than that is split by its third word. One pass sends each suffix, counted
  within its run of text, to the group of its prefix.
* Each group builds its subtree alone: equal suffixes make a leaf, leaves with the same
  three words a node, and a node counts what its leaves do.

Which prefixes count is told to the tasks by a bit table of a fixed size. A bit that two
prefixes share lets some suffixes through that count for nothing; it drops none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrier.llm.common import few_keys
from terrier.session import staged

#: Occurrences of a candidate, words of the longest one, and phrases reported by language.
LEAST, LONGEST, TOP = 30, 4, 2000
#: A phrase is dropped inside a longer one that has this share (in hundredths) of its occurrences.
INSIDE = 80
#: Suffixes of a group, and words of text that a task counts together.
BUDGET, RUN = 1 << 20, 3 << 19
#: Bits of a bit table (as powers of two), and cells of prefixes that groups are packed from.
BITS, CELLS = (16, 27), (8, 20)
#: Different words that a task counts before it hands them on.
COUNTED = 400_000
#: Separators of pieces become a word of their own, which no word can be.
CUTS, BREAK = b".,;:!?\n\x0b\x0c\r", b"."
_TO_BREAK = bytes.maketrans(CUTS, BREAK * len(CUTS))
SEED = 42


def words_and_breaks(text: str) -> list[bytes]:
    """Words with A-Z in lower case, and breaks between pieces."""
    cut = text.encode("utf-8", "surrogatepass").lower().translate(_TO_BREAK)
    return cut.replace(BREAK, b" . ").split()


def _hash(lang: bytes) -> int:
    return xxhash.xxh64_intdigest(lang, SEED)


def _strings(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary()).cast(pa.string())


def _joined(names: pa.Array, *numbers: np.ndarray) -> pa.Array:
    """The phrases of the words with the given numbers."""
    return pc.binary_join_element_wise(*(names.take(pa.array(n)) for n in numbers), " ")


def _batches(columns: dict[str, pa.Array], lang: str, size: int = 50_000) -> Iterator[pa.RecordBatch]:
    """The columns with one language, in batches."""
    rows = len(next(iter(columns.values())))
    whole = pa.RecordBatch.from_arrays([pa.repeat(lang, rows), *columns.values()], ["lang", *columns])
    for at in range(0, rows, size):
        yield whole.slice(at, size)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter[bytes]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, found in counts.items():
            found.pop(BREAK, None)
            yield from _batches({"phrase": _strings(list(found)), "n": pa.array(found.values(), pa.int64())}, lang)
        counts.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            counts.setdefault(lang.as_py(), Counter()).update(words_and_breaks(text.as_py()))
        if sum(map(len, counts.values())) > COUNTED:
            yield from out()
    yield from out()


def bit_table(phrases: DataFrame) -> np.ndarray:
    """One bit for the hash of each (lang, phrase), as 64-bit words; 16 MB at most."""
    bits = int(np.clip(np.ceil(np.log2(16 * max(1, phrases.count()))), *BITS))
    at = F.xxhash64("lang", "phrase").bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    words = phrases.select(at.alias("at")).selectExpr("at div 64 AS word", "shiftleft(1L, cast(at & 63 AS int)) AS bit")
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most 2^21 rows
    table = np.zeros((1 << bits) // 64, np.uint64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return table


def _has(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(64 * len(table) - 1)
    return (table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0


class _Words(dict):
    """Numbers of the words of one language that may be frequent; 0 for breaks and all others."""

    def __init__(self, lang: str, table: np.ndarray) -> None:
        super().__init__({BREAK: 0})
        self.seed, self.table, self.names, self.rows = _hash(lang.encode()), table, [b""], []

    def __missing__(self, word: bytes) -> int:
        at = xxhash.xxh64_intdigest(word, self.seed) & (64 * len(self.table) - 1)
        number = 0
        if int(self.table[at >> 6]) >> (at & 63) & 1:
            number = len(self.names)
            self.names.append(word)
        self[word] = number
        return number


def _runs(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[tuple[str, _Words, np.ndarray]]:
    """Each language's texts in runs of about ``RUN`` words, as numbers with breaks (0) between pieces."""
    held: dict[str, _Words] = {}
    size = 0

    def out() -> Iterator[tuple[str, _Words, np.ndarray]]:
        while held:
            lang, words = held.popitem()
            numbers = np.concatenate(words.rows)
            words.rows.clear()
            yield lang, words, numbers
        pa.default_memory_pool().release_unused()  # workers live on

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            lang, found = lang.as_py(), words_and_breaks(text.as_py())
            words = held.get(lang)
            if words is None:
                words = held[lang] = _Words(lang, table)
            found.append(BREAK)
            words.rows.append(np.fromiter(map(words.__getitem__, found), np.int32, len(found)))
            size += len(found)
            if size >= RUN:
                yield from out()
                size = 0
    yield from out()


def _pairs(numbers: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The code of each pair of neighbours, and whether both are words that may be frequent."""
    return numbers[:-1].astype(np.int64) * size + numbers[1:], (numbers[:-1] > 0) & (numbers[1:] > 0)


def _count_pairs(table: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, numbers in _runs(batches, table.value):
            names, size = _strings(words.names), len(words.names)
            codes, good = _pairs(numbers, size)
            found, counts = np.unique(codes[good], return_counts=True)
            yield from _batches({"phrase": _joined(names, found // size, found % size), "n": pa.array(counts)}, lang)
    return run


class Groups:
    """The group of each two-word prefix, packed from the cells of the prefixes' hashes."""

    def __init__(self, pairs: DataFrame, budget: int = BUDGET) -> None:
        hashed = pairs.select(F.xxhash64("lang", "phrase").alias("hash"), "n")
        total = pairs.agg(F.sum("n")).first()[0] or 0
        self.bits = int(np.clip(np.ceil(np.log2(max(1, 16 * total / budget))), *CELLS))
        cell = F.shiftrightunsigned("hash", 64 - self.bits)
        # one row a cell, and one for each prefix that holds a budget of all suffixes: at most total / budget
        cells = hashed.filter(F.col("n") <= budget).groupBy(cell.alias("cell")).agg(F.sum("n").alias("n")).collect()
        large = hashed.filter(F.col("n") > budget).collect()
        weights = np.zeros(1 << self.bits, np.int64)
        for r in cells:
            weights[r.cell] = r.n
        self.of_cell, group, load = np.zeros(len(weights), np.int64), 0, 0
        for i, n in enumerate(weights.tolist()):
            if load and load + n > budget:
                group, load = group + 1, 0
            self.of_cell[i] = group
            load += n
        self.split: dict[int, tuple[int, int]] = {}
        for r in sorted(large, key=lambda r: r.hash):
            parts = -(-r.n // budget) * 2
            self.split[r.hash & (1 << 64) - 1] = (group + 1, parts)
            group += parts
        self.number = group + 1

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Groups of two-word prefixes by their hashes."""
        return self.of_cell[hashes >> np.uint64(64 - self.bits)]


def _suffixes(words_table: Broadcast, pairs_table: Broadcast, groups: Broadcast):
    """(lang, group, head, tail, n): suffixes of three words (no tail) or four, cut where a pair is not frequent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan: Groups = groups.value
        for lang, words, numbers in _runs(batches, words_table.value):
            names, size = _strings(words.names), len(words.names)
            codes, good = _pairs(numbers, size)
            pairs = np.unique(codes[good])
            if len(pairs):
                prefixes = _joined(names, pairs // size, pairs % size).to_pylist()
                hashes = np.fromiter((xxhash.xxh64_intdigest(p, words.seed) for p in prefixes), np.uint64, len(pairs))
                known = _has(pairs_table.value, hashes)
                pairs, hashes = pairs[known], hashes[known]
            if not len(pairs):
                continue
            at = np.minimum(np.searchsorted(pairs, codes), len(pairs) - 1)  # the frequent pair at each place, or -1
            at = np.where(good & (pairs[at] == codes), at, -1)
            start = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
            fourth = np.append(at, -1)[start + 2]
            # the rest of a suffix: its third word, or the pair of its third and fourth
            rest = np.where(fourth >= 0, size + fourth, numbers[start + 2])
            width = size + len(pairs)
            found, counts = np.unique(at[start] * width + rest, return_counts=True)
            first, rest = found // width, found % width
            pair = pairs[np.maximum(rest - size, 0)]
            third = np.where(rest < size, rest, pair // size)
            tail = pa.array(pair % size, mask=rest < size)
            group = plan.of(hashes[first])
            for hashed, (low, parts) in plan.split.items():
                for k in np.flatnonzero(hashes[first] == np.uint64(hashed)).tolist():
                    group[k] = low + xxhash.xxh64_intdigest(words.names[third[k]], hashed) % parts
            yield from _batches({"group": pa.array(group), "head": _joined(names, pairs[first] // size, pairs[first] % size, third),
                                 "tail": names.take(tail), "n": pa.array(counts)}, lang)
    return run


def _subtree(group: pa.Table) -> pa.Table:
    """Counts of the phrases of three and four words of one group, from the totals of its leaves."""
    leaves = group.group_by(["lang", "head", "tail"]).aggregate([("n", "sum")])
    nodes = leaves.group_by(["lang", "head"]).aggregate([("n_sum", "sum")]).rename_columns(["lang", "phrase", "n"])
    ends = leaves.filter(pc.is_valid(leaves["tail"]))
    ends = pa.table([ends["lang"], pc.binary_join_element_wise(ends["head"], ends["tail"], " "), ends["n_sum"]],
                    names=["lang", "phrase", "n"])
    both = pa.concat_tables([nodes, ends])
    return both.filter(pc.greater_equal(both["n"], LEAST))


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang",
                  budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n) of all phrases of one to four words seen ``LEAST`` times, and (lang, n) of all words."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"),
                        F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = "lang string, phrase string, n long"
    suffix = "lang string, group long, head string, tail string, n long"
    sums = F.sum("n").alias("n")
    all_words = staged(texts.mapInArrow(_count_words, schema).groupBy("lang", "phrase").agg(sums))
    words = all_words.filter(F.col("n") >= LEAST)
    known = sc.broadcast(bit_table(words))
    pairs = staged(texts.mapInArrow(_count_pairs(known), schema).groupBy("lang", "phrase").agg(sums)
                   .filter(F.col("n") >= LEAST))
    groups = sc.broadcast(Groups(pairs, budget))
    suffixes = texts.mapInArrow(_suffixes(known, sc.broadcast(bit_table(pairs)), groups), suffix)
    longer = staged(suffixes.groupBy("group").applyInArrow(_subtree, schema))
    return words.unionByName(pairs).unionByName(longer), staged(all_words.groupBy("lang").agg(sums))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    a, l and r count the phrase and its two parts at the cut that scores least, n all words
    of the language; score is 2,000,000 a / (l + r), rounded down. Phrases that lie inside
    a longer candidate with 80% of their occurrences are left out. Ties go by a, then by
    phrase in byte order; equal cuts to the first. A null language is ``und``; null, empty
    and blank texts have no words; repeated rows count again. Other columns are ignored.
    Tables without candidates give no rows.
    """
    counted, totals = phrase_counts(docs, text, lang)
    words = F.split("phrase", " ")
    phrases = counted.select("lang", "phrase", F.col("n").alias("a"), words.alias("w"))
    longer = phrases.filter(F.size("w") > 1)

    def joined(start, size):
        return F.array_join(F.slice("w", start, size), " ")

    parts = longer.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.explode(F.array(
            F.struct(F.lit(True).alias("left"), joined(F.lit(1), F.col("k")).alias("part")),
            F.struct(F.lit(False).alias("left"), joined(F.col("k") + 1, F.size("w")).alias("part")))).alias("p"))
    sizes = counted.select("lang", F.col("phrase").alias("part"), "n")
    cuts = (parts.select("lang", "phrase", "a", "k", "p.left", "p.part").join(sizes, ["lang", "part"])
            .groupBy("lang", "phrase", "k").agg(
                F.max("a").alias("a"), F.max(F.when(F.col("left"), F.col("n"))).alias("l"),
                F.max(F.when(~F.col("left"), F.col("n"))).alias("r")))
    score = F.expr("(CAST(a AS DECIMAL(20, 0)) * CAST(2000000 AS DECIMAL(7, 0))) "
                   "div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")
    scored = cuts.groupBy("lang", "phrase").agg(
        F.max("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("w") - 1), lambda size: F.transform(
        F.sequence(F.lit(1), F.size("w") - size + 1), lambda at: F.array_join(F.slice("w", at, size), " "))))
    around = longer.filter(F.size("w") > 2).select("lang", F.explode(inner).alias("phrase"), "a").groupBy(
        "lang", "phrase").agg(F.max("a").alias("around"))
    share = F.expr(f"CAST(around AS DECIMAL(20, 0)) * 100 >= CAST(a AS DECIMAL(20, 0)) * {INSIDE}")
    alone = scored.join(around, ["lang", "phrase"], "left").filter(~F.coalesce(share, F.lit(False)))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    best = alone.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return best.join(few_keys(totals), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
