"""Language-model scores by weighted backoff over counted n-grams.

A text is read once: tasks write down its tokens in chunks, as codes of the chunk's own words.
For each level, a chunk sends the sorted 64-bit keys of its distinct n-grams to the parts of the
key space, packed by their gaps, and the parts answer with counts. A longer n-gram is sent only
where both of its shorter ones are kept, since it cannot be seen oftener than they are. Every
n-gram seen ``LEAST`` times is kept, whatever the size of the corpus.

The model is the kept keys by parts, with their counts and those of what follows them. Scoring
sends keys the same way and works out each chance beside its text. Only a core of frequent rows
is broadcast, as a cache: it saves questions and changes no result.

The chance of a word after a context is its discounted share of what follows, and the mass the
context leaves times the chance after the next shorter context; a context that nothing kept
follows adds nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce as fold
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrier.llm.common import slices, words_of
from terrier.llm.packing import gaps, ordered, packed, part_starts, unpacked
from terrier.session import discarded, settled

#: Occurrences from which an n-gram of several words is kept.
LEAST = 2
#: Shares of all tokens below which words enter no n-gram, and n-grams are left out: none.
WORD_RATE, GRAM_RATE = 0.0, 0.0
#: Share of all tokens from which a row is broadcast too: at most 500,000 a level.
CORE_RATE = 2e-6
#: Taken off each count of an n-gram for shorter contexts.
DISCOUNT = 0.75
#: The end of a text; white space, so no word is equal to it.
END = b"\n"
#: Tokens of a chunk, and tokens for which there is a part of the key space at least.
GATHERED, PART_TOKENS = 2_000_000, 2_000_000
#: Kinds of rows besides levels: the tokens of a chunk, rows of the model, what follows contexts.
TOKENS, MODEL, FOLLOWERS = -1, -2, 0
ROWS = "part int, chunk long, kind int, body binary, n long"


def tokens_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, then the end."""
    words = words_of(text or "")
    words.append(END)
    return words


def chained(words: np.ndarray, seed: np.ndarray | int = 42) -> np.ndarray:
    """Spark's xxhash64 of one more bigint; ``seed`` is the hash of those before."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (
        0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turned(x: np.ndarray, by: int) -> np.ndarray:
        return x << np.uint64(by) | x >> np.uint64(64 - by)
    out = np.asarray(seed, np.uint64) + (p5 + np.uint64(8)) ^ turned(words * p2, 31) * p1
    out = turned(out, 27) * p1 + p4
    out = (out ^ out >> np.uint64(33)) * p2
    out = (out ^ out >> np.uint64(29)) * p3
    return out ^ out >> np.uint64(32)


def _chunks(docs: DataFrame, keep: list[Column | str], text: str) -> DataFrame:
    """``keep`` of every row, its chunk, its place there and its number of tokens; the tokens of a chunk are with one of its rows."""
    source = docs.select(*keep, F.col(text).alias("__text"))
    schema = source.drop("__text").withColumns({
        "__chunk": F.lit(0).cast("long"), "__at": F.lit(0), "n_tokens": F.lit(0).cast("long"),
        "__all": F.lit(None).cast("long"), "__tokens": F.lit(None).cast("binary")}).schema

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        tokens, sizes, runs = [], [], []

        def chunk() -> Iterator[pa.RecordBatch]:
            nonlocal made
            coded = pa.concat_arrays(tokens).dictionary_encode()
            found, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            often = np.argsort(-np.bincount(found, minlength=len(words)), kind="stable")
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))[often]
            rank = np.empty(len(often), np.uint32)
            rank[often] = np.arange(len(often), dtype=np.uint32)
            body = packed(hashes, rank[found], np.array(sizes))
            at, own = 0, task + (made << 32)
            for run in runs:
                n = run.num_rows
                rest = pa.nulls(n - 1 if not at else n, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    run.columns[:-1] + [pa.array(np.full(n, own)), pa.array(np.arange(at, at + n, dtype=np.int32)),
                                        pa.array(np.array(sizes[at: at + n], np.int64)),
                                        pa.concat_arrays([pa.array([] if at else [len(found)], pa.int64()), pa.nulls(len(rest), pa.int64())]),
                                        pa.concat_arrays([pa.array([] if at else [body], pa.binary()), rest])],
                    run.schema.names[:-1] + ["__chunk", "__at", "n_tokens", "__all", "__tokens"])
                at += n
            made += 1
            for held in (tokens, sizes, runs):
                held.clear()
        for batch in batches:
            for run, texts in slices(batch):
                runs.append(run)
                split = [tokens_of(value) for value in texts]
                sizes += map(len, split)
                tokens.append(pa.array(chain.from_iterable(split), pa.binary()))
                if sum(sizes) >= GATHERED:
                    yield from chunk()
        if runs:
            yield from chunk()
    return settled(source.mapInArrow(write, schema))


class Grams:
    """The n-grams of a chunk, one level after the other: all places where one starts, and the distinct keys, sorted."""

    def __init__(self, body: bytes) -> None:
        hashes, codes, sizes = unpacked(body)
        self.sizes, self.k = sizes.astype(np.int64), 1
        self.words = hashes[codes]
        ends = np.cumsum(self.sizes).repeat(self.sizes)
        self.left = (ends - np.arange(len(codes))).astype(np.int32)
        keys = chained(hashes)
        order = ordered(keys)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.key, self.keys, self.at = keys[codes], keys[order], np.arange(len(codes), dtype=np.int32)
        self.inverse, self.counts = rank[codes], np.bincount(codes.astype(np.int64), minlength=len(order))[order]

    def longer(self, kept: np.ndarray | None) -> None:
        """On to n-grams of one more word, of two ``kept`` places where they are given."""
        self.k += 1
        at = self.left >= self.k
        if kept is not None:
            at[:-1] &= kept[:-1] & kept[1:]
        self.at = np.flatnonzero(at).astype(np.int32)
        self.context = self.key
        found = chained(self.words[self.at + (self.k - 1)], self.context[self.at])
        self.key = np.zeros(len(self.words), np.uint64)
        self.key[self.at] = found
        order = ordered(found)
        found = found[order]
        fresh = np.ones(len(found), bool)
        fresh[1:] = found[1:] != found[:-1]
        starts = np.flatnonzero(fresh)
        self.keys, self.first, self.counts = found[starts], self.at[order[starts]], np.diff(starts, append=len(found))
        self.inverse = np.empty(len(order), np.int32)
        self.inverse[order] = np.cumsum(fresh, dtype=np.int32) - np.int32(1)

    def spread(self, values: np.ndarray) -> np.ndarray:
        """A value for each place from those of the keys; 0 where none starts."""
        out = np.zeros(len(self.words), values.dtype)
        out[self.at] = values[self.inverse]
        return out


def _sent(chunk: int, kind: int, starts: np.ndarray, keys: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows for the parts that sorted keys fall in, with the numbers beside them."""
    cuts = np.append(np.searchsorted(keys, starts), len(keys))
    parts = np.flatnonzero(np.diff(cuts))
    if len(parts):
        yield _rows([(int(p), chunk, kind, packed(gaps(keys[cuts[p]: cuts[p + 1]], starts[p]), *(c[cuts[p]: cuts[p + 1]] for c in columns)),
                      int(cuts[p + 1] - cuts[p])) for p in parts])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["part", "chunk", "kind", "body", "n"])


def _answers(found: dict[int, bytes], width: int, starts: np.ndarray, keys: np.ndarray) -> list[np.ndarray]:
    """The parts' answers to sorted keys, ``width`` numbers each."""
    cuts = np.append(np.searchsorted(keys, starts), len(keys))
    out = [np.zeros(len(keys), np.int64) for _ in range(width)]
    for part in np.flatnonzero(np.diff(cuts)):
        for column, values in zip(out, unpacked(found[int(part)]), strict=True):
            column[cuts[part]: cuts[part + 1]] = values.view(np.int64)
    return out


def _by(column: str, batches: Iterator[pa.RecordBatch]) -> dict[int, list[tuple]]:
    """Rows (part, chunk, kind, body) of a task by their part or chunk."""
    held = defaultdict(list)
    for batch in batches:
        for key, *row in zip(*(batch.column(c).to_pylist() for c in (column, "part", "chunk", "kind", "body"))):
            held[key].append(row)
    return held


def _chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Grams, dict[int, dict[int, bytes]]]]:
    """Each chunk with its words, and the answers that came for it by level and part."""
    for chunk, rows in _by("chunk", batches).items():
        found: dict[int, dict[int, bytes]] = defaultdict(dict)
        for part, _, kind, body in rows:
            found[kind][part] = body
        yield chunk, Grams(found.pop(TOKENS)[-1]), found


def _counted(least: float, parts: int) -> Callable:
    """Counts of keys by part: rows of the table (chunk -1), and answers, 2 n, 1 more for one of the chunks; sums of followers."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = part_starts(parts)
        for part, rows in _by("part", batches).items():
            kinds = defaultdict(list)
            for _, chunk, kind, body in rows:
                kinds[kind].append((chunk, body))
            for kind, bodies in kinds.items():
                columns = [unpacked(body) for _, body in bodies]
                sizes = [len(c[0]) for c in columns]
                keys, *numbers = (np.concatenate(c) for c in zip(*((starts[part] + np.cumsum(c[0]), *c[1:]) for c in columns)))
                order = ordered(keys)
                keys = keys[order]
                fresh = np.ones(len(keys), bool)
                fresh[1:] = keys[1:] != keys[:-1]
                at = np.flatnonzero(fresh)
                sums = [np.add.reduceat(n[order], at) for n in numbers]
                own = sums[0] >= (least if kind > 1 else 1)
                yield _rows([(part, -1, kind, packed(gaps(keys[at[own]], starts[part]), *(n[own] for n in sums)), int(own.sum()))])
                if kind == FOLLOWERS:
                    continue
                told = np.empty(len(keys), np.uint64)
                told[order] = (np.where(own, sums[0], 0).astype(np.uint64) * np.uint64(2))[np.cumsum(fresh) - 1] + (fresh & own[np.cumsum(fresh) - 1])
                for (chunk, _), values in zip(bodies, np.split(told, np.cumsum(sizes)[:-1])):
                    yield _rows([(part, chunk, kind, packed(values), len(values))])
    return count


def _asked(order: int, upto: int, parts: int, word_least: float) -> Callable:
    """Keys of the next level of each chunk with their counts (of the first two, where nothing is told), and what follows contexts at ``upto``."""
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = part_starts(parts)
        for chunk, grams, told in _chunks_of(batches):
            kept = None
            if not upto:
                yield from _sent(chunk, 1, starts, grams.keys, grams.counts)
            for k in range(1, upto + 1):
                if k > 1:
                    grams.longer(kept if k > 2 else None)
                answer, = _answers(told[k], 1, starts, grams.keys)
                n, mine = answer >> 1, (answer & 1).astype(bool)
                if k == 1:
                    known = kept = grams.spread(n >= word_least)
                    continue
                if k == 2:
                    both = known[grams.first] & known[grams.first + 1]
                    n, mine = n * both, mine & both
                kept = grams.spread(n > 0)
                if k == upto:
                    context, to = np.unique(grams.context[grams.first[mine]], return_inverse=True)
                    yield from _sent(chunk, FOLLOWERS, starts, context, np.bincount(to, n[mine], len(context)), np.bincount(to, minlength=len(context)))
            if upto < order and (upto or order > 1):
                grams.longer(kept if upto else None)
                yield from _sent(chunk, grams.k, starts, grams.keys, grams.counts)
    return ask


def _model_rows(parts: int) -> Callable:
    """One row a part: keys, counts, and sums of the counts and numbers of what follows."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = part_starts(parts)
        for part, rows in _by("part", batches).items():
            kept, follow = ([unpacked(body) for _, _, kind, body in rows if (kind == FOLLOWERS) == late] for late in (False, True))
            keys, n = (np.concatenate(c) for c in zip(*((starts[part] + np.cumsum(c[0]), c[1]) for c in kept)))
            order = ordered(keys)
            keys, n = keys[order], n[order]
            taken, kinds = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
            for gap, sums, several in follow:
                at = np.searchsorted(keys, starts[part] + np.cumsum(gap))
                taken[at] += sums
                kinds[at] += several
            yield _rows([(part, -1, MODEL, packed(gaps(keys, starts[part]), n, taken, kinds), len(keys))])
    return build


def _looked_up(parts: int) -> Callable:
    """Answers to keys: the three numbers of the model, 0 where it has none."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = part_starts(parts)
        for part, rows in _by("part", batches).items():
            table = next((unpacked(body) for _, _, kind, body in rows if kind == MODEL), None)
            keys = starts[part] + np.cumsum(table[0]) if table else np.empty(0, np.uint64)
            for _, chunk, kind, body in rows:
                if kind != MODEL:
                    asked = starts[part] + np.cumsum(unpacked(body)[0])
                    hit, spot = np.zeros(len(asked), bool), np.zeros(len(asked), np.int64)
                    if len(keys):
                        spot = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                        hit = keys[spot] == asked
                    values = [np.where(hit, c[spot], np.uint64(0)) for c in table[1:]] if len(keys) else [hit] * 3
                    yield _rows([(part, chunk, kind, packed(*values), len(asked))])
    return look


def _core_rows(least: float, parts: int) -> Callable:
    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = part_starts(parts)
        for batch in batches:
            for part, body in zip(batch.column("part").to_pylist(), batch.column("body").to_pylist()):
                gap, *numbers = unpacked(body)
                own = numbers[0] >= least
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[own].view(np.int64)) for c in (starts[part] + np.cumsum(gap), *numbers)], ["key", "n", "taken", "kinds"])
    return select


class Core:
    """The rows of the frequent n-grams by key: a cache of the model."""

    def __init__(self, rows: pa.Table) -> None:
        keys = rows.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.values = [rows.column(c).to_numpy()[order] for c in ("n", "taken", "kinds")]

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys, -1 for those outside."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        spot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[spot] == keys, spot, -1)


class LanguageModel:
    """The staged rows of all parts, the core, and what was counted."""

    def __init__(self, order: int, total: int, distinct: int, word_least: float, parts: int, core: Core, rows: DataFrame) -> None:
        self.order, self.total, self.distinct, self.word_least = order, total, distinct, word_least
        self.parts, self.core, self.rows = parts, core, rows


def _width(spark: SparkSession, least: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), least)


def _met(chunks: DataFrame, told: list[DataFrame], width: int) -> DataFrame:
    """Chunks with the answers for them."""
    rows = [t.filter("chunk >= 0") for t in told]
    return fold(DataFrame.unionByName, [_tokens(chunks), *rows]).repartitionById(width, F.expr(f"cast(pmod(chunk, {width}) as int)"))


def _tokens(chunks: DataFrame) -> DataFrame:
    return chunks.filter("__tokens IS NOT NULL").select(
        F.lit(-1).alias("part"), F.col("__chunk").alias("chunk"), F.lit(TOKENS).alias("kind"), F.col("__tokens").alias("body"), F.col("__all").alias("n"))


def train(docs: DataFrame, order: int = 3, text: str = "text") -> LanguageModel:
    """The model of all rows of ``docs``; null text is an empty one. No rows: nothing is known."""
    spark = docs.sparkSession
    chunks = _chunks(docs, [], text)
    row = chunks.agg(F.sum("__all"), F.count("__all")).first()
    total, width = row[0] or 0, _width(spark, row[1])
    parts = _width(spark, total // PART_TOKENS + 1)
    word_least, least = WORD_RATE * total, max(float(LEAST), GRAM_RATE * total)
    told: list[DataFrame] = []
    for upto in [0, *range(min(order, 2), order + 1)] if order > 1 else [0]:
        met = _met(chunks, told, width) if told else _tokens(chunks)
        told.append(settled(met.mapInArrow(_asked(order, upto, parts, word_least), ROWS)
                            .repartitionById(parts, "part").mapInArrow(_counted(least, parts), ROWS)))
    table = fold(DataFrame.unionByName, told).filter("chunk < 0")
    distinct = table.filter("kind = 1").agg(F.sum("n")).first()[0] or 0
    rows = settled(table.repartitionById(parts, "part").mapInArrow(_model_rows(parts), ROWS))
    discarded(chunks, *told)
    often = rows.mapInArrow(_core_rows(max(1.0, CORE_RATE * total), parts), "key long, n long, taken long, kinds long")
    return LanguageModel(order, total, distinct, word_least, parts, Core(often.toArrow()), rows)  # at most order / CORE_RATE rows


def _scored(model: LanguageModel, shared, upto: int) -> Callable:
    """Keys of the next level of each chunk that are not in the core; at the last, known words and both sums of each of its texts."""
    order, parts, total, distinct, word_least = model.order, model.parts, model.total, model.distinct, model.word_least

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, starts = shared.value, part_starts(parts)

        def ask(chunk: int, grams: Grams) -> Iterator[pa.RecordBatch]:
            return _sent(chunk, grams.k, starts, grams.keys[core.places(grams.keys) < 0])

        def values(grams: Grams, told: dict[int, bytes]) -> list[np.ndarray]:
            place = core.places(grams.keys)
            rest = np.flatnonzero(place < 0)
            out = [np.where(place < 0, 0, c[place]) if len(c) else np.zeros(len(place), np.int64) for c in core.values]
            for column, answer in zip(out, _answers(told, 3, starts, grams.keys[rest])):
                column[rest] = answer
            return out
        for chunk, grams, told in _chunks_of(batches):
            kept = None
            if not upto:
                yield from ask(chunk, grams)
            for k in range(1, upto + 1):
                if k > 1:
                    grams.longer(kept if k > 2 else None)
                n, taken, kinds = values(grams, told[k])
                if k == 1:
                    text = np.arange(len(grams.sizes), dtype=np.int32).repeat(grams.sizes)
                    heads, many = (n + 1.0)[grams.inverse], (n > 0)[grams.inverse]
                    floor = np.log10(total + distinct + 1)
                    seen = np.bincount(text[many], minlength=len(grams.sizes))
                    base = np.bincount(text, np.log10(heads), len(grams.sizes)) - grams.sizes * floor
                    chance = heads / float(total + distinct + 1)
                    known = kept = grams.spread(n >= max(word_least, 1))
                else:
                    if k == 2:
                        n = n * (known[grams.first] & known[grams.first + 1])
                    own = grams.spread(n)
                    at = np.flatnonzero(before[2] > 0) if upto == order else np.empty(0, np.int64)
                    at = at[grams.left[at] >= k]
                    of, last = before[0][at], at + (k - 1)
                    left = 1 - (before[1][at] - DISCOUNT * before[2][at]) / of
                    chance[last] = np.where(own[at] > 0, own[at] - DISCOUNT, 0) / of + left * chance[last]
                    kept = own > 0
                before = [grams.spread(c) for c in (n, taken, kinds)] if k < order else None
            if upto == order:
                score = np.bincount(text, np.log10(chance), len(grams.sizes))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(seen), chunk)), pa.array(np.arange(len(seen), dtype=np.int32)), pa.array(seen), pa.array(base), pa.array(score)],
                    ["__chunk", "__at", "n_known", "base_score", "score"])
            elif upto or order > 1:
                grams.longer(kept if upto else None)
                yield from ask(chunk, grams)
    return walk


def score(docs: DataFrame, model: LanguageModel, keep: list[Column | str], text: str = "text") -> DataFrame:
    """``keep`` columns of every row with n_tokens, n_known, train_tokens, base_score and score.

    ``base_score`` is the add-one unigram log10 probability, ``score`` that of the
    n-grams with the same unigrams below them. Null and empty texts are the end
    alone. Repeated rows each give their row.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model.core)  # bounded by the rate
    chunks = _chunks(docs, keep, text)
    width, parts = _width(spark, chunks.filter("__tokens IS NOT NULL").count()), model.parts
    own = chunks.columns[:-5]
    told: list[DataFrame] = []
    for upto in [0, *range(2, model.order)]:
        met = _met(chunks, told, width) if told else _tokens(chunks)
        asked = met.mapInArrow(_scored(model, shared, upto), ROWS)
        told.append(settled(asked.unionByName(model.rows).repartitionById(parts, "part").mapInArrow(_looked_up(parts), ROWS)))
    found = settled(_met(chunks, told, width).mapInArrow(
        _scored(model, shared, model.order), "__chunk long, __at int, n_known long, base_score double, score double"))
    discarded(*told)
    return chunks.join(found, ["__chunk", "__at"]).select(
        *own, "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
