"""Near duplicates of whole texts by min-max hashing.

Each random permutation of the shingles gives two signature values, its minimum and
its maximum, for one evaluation per shingle. Values are banded; the candidates of a
band are confirmed on the full shingle sets.

* Texts of equal shingle sets are one class, found by one grouping.
* Star steps: every class is paired with one other only, first with the lowest class of
  most of its buckets. Confirmed pairs make components. Then, in buckets that hold several
  components, each class outside the largest is paired with another member of it, round by
  round, as long as a round ties a good part of them.
* Block step: where buckets still hold several components, the classes outside the
  largest meet all others in blocks of bounded size. Each pair is looked at once, in
  the first band it shares, and confirmed inside the task; only links leave it.

So no pair of a bucket is lost, and a bucket of near copies never emits all its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrier.llm.common import few_keys, words_of
from terrier.llm.components import components
from terrier.session import staged

#: Words of a shingle, and the similarity in hundredths from which texts are linked.
SHINGLE, PERCENT = 5, 75
#: Values of a band, and permutations: a pair of similarity 0.75 shares no band once in 4 million.
BAND, PERMUTATIONS = 4, 80
#: Signatures that agree in a smaller share are not confirmed: five deviations below 0.75.
LEAST_AGREEMENT = 0.58
#: Classes of one block, and ids up to which an id list (8 bytes each) is broadcast.
BLOCK, BROADCAST_IDS = 256, 1 << 20
#: Stars are repeated while a round ties one in so many of the classes that are apart.
STAR_GAIN = 5
WORDS_KEPT = 500_000


class WordHashes(dict):
    """64-bit hashes of words, worked out once while remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text.

    A text of fewer words is one shingle, its whole sequence; one without words has none.
    """
    words = words_of(text or "")
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    last = len(words) - width + 1
    out = np.full(last, width, np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + _mixed(each[k: last + k])
    return np.unique(_mixed(out))


def _permutations(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64))


def signature(items: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Top 16 bits of minimum and maximum under each permutation: bands of minima, then of maxima."""
    low = np.full(len(scale), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(scale), np.uint64)
    for at in range(0, len(items), 512):  # all permutations of a slice stay in the cache
        values = np.multiply.outer(scale, items[at: at + 512])
        values += shift[:, None]
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    # minima crowd near zero in long texts: mix before cutting to 16 bits
    return (_mixed(np.concatenate([low, high])) >> np.uint64(48)).astype(np.uint16)


def _digest(items: bytes) -> bytes:
    """The digest of a packed shingle set."""
    return hashlib.blake2b(items, digest_size=16).digest()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, (scale, shift) = WordHashes(), _permutations()
    for batch in batches:
        sizes, sets, bands = [], [], []
        for text in batch.column(1):
            items = shingles(text.as_py(), hashes)
            sizes.append(len(items))
            if len(items):
                sets.append(_digest(items.tobytes()))
                bands.append(signature(items, scale, shift).view(np.int64))
            else:
                sets.append(None)
                bands.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary()),
             pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set", "bands"])


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set (digest of the set), bands (of ``doc_id`` and ``text``)."""
    return docs.select("doc_id", "text").mapInArrow(
        _sketch, f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, set binary, bands array<long>")


def alike(left: bytes, right: bytes) -> bool:
    """Whether two full shingle sets (sorted, packed) are similar enough."""
    x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
    small, large = sorted((len(x), len(y)))
    if not small or 100 * small < PERCENT * large:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (small + large - both)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        items = [shingles(t.as_py(), hashes).tobytes() for t in batch.column(2)]
        own = pa.array([_digest(x) == s.as_py() for x, s in zip(items, batch.column(1))], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.binary())], ["id", "item"]).filter(own)


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id and item, the packed shingle set, of ``wanted`` (id, doc_id, set) from texts (doc_id, text).

    One doc_id may have several texts; the digest tells which of them is meant.
    """
    found = docs.join(wanted, "doc_id").select("id", "set", "text").mapInArrow(_sets, "id long, item binary")
    return found.dropDuplicates(["id"])


def _across(like: Callable[[bytes, bytes], bool], agreement: float):
    """Links across labels within each run of rows of one (key, left, right)."""
    def links(block: pa.Table) -> pa.RecordBatch | None:
        ids, label, part = (block.column(c).to_numpy() for c in ("id", "label", "part"))
        bands = np.array(block.column("bands").to_pylist(), np.int64)
        items, band = block.column("item"), block.column("band")[0].as_py()
        within = block.column("left")[0].as_py() == block.column("right")[0].as_py()
        label, a, b = label.copy(), [], []
        values = bands.view(np.uint16)
        for i in range(len(ids) - 1):
            rest = np.flatnonzero(label[i + 1:] != label[i]) + i + 1
            if not within:
                rest = rest[part[rest] != part[i]]
            same = bands[rest] == bands[i]
            rest = rest[same.argmax(axis=1) == band] if len(rest) else rest  # a pair is looked at in its first shared band
            if agreement and len(rest):
                rest = rest[(values[rest] == values[i]).mean(axis=1) >= agreement]
            for j in rest.tolist():
                if label[i] != label[j] and like(items[i].as_py(), items[j].as_py()):
                    a.append(min(ids[i], ids[j]))
                    b.append(max(ids[i], ids[j]))
                    label[label == label[j]] = label[i]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]) if a else None

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            keys = np.stack([held.column(c).to_numpy() for c in ("key", "left", "right")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for start, end in zip(np.append(0, cuts[:-1]), cuts):
                if (out := links(held.slice(start, end - start))) is not None:
                    yield out
            if len(cuts):
                held = held.slice(cuts[-1])
        if held is not None and held.num_rows and (out := links(held)) is not None:
            yield out
    return runs


def _confirmed(pairs: DataFrame, items: DataFrame, like: Callable[[bytes, bytes], bool]) -> DataFrame:
    """The rows of ``pairs`` (a, b, ...) whose items are alike."""
    kept = pairs.columns

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [like(x.as_py(), y.as_py()) for x, y in zip(batch.column("x"), batch.column("y"))]
            yield batch.filter(pa.array(good, pa.bool_())).select(kept)
    return (pairs.join(items.select(F.col("id").alias("a"), F.col("item").alias("x")), "a")
            .join(items.select(F.col("id").alias("b"), F.col("item").alias("y")), "b")
            .select(*kept, "x", "y").mapInArrow(check, pairs.schema))


def _mixed_buckets(members: DataFrame) -> DataFrame:
    """Members (key, band, id, label) of buckets with several labels, with what the bucket holds.

    ``main`` is the label of most members, ``most`` and ``few`` the members inside and outside it.
    """
    sizes = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = sizes.groupBy("key").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("most"),
        (F.sum("n") - F.max("n")).alias("few")).filter("few > 0")
    return staged(members.select("key", "band", "id", "label").join(mixed, "key"))


def linked(classes: DataFrame, items: Callable[[DataFrame], DataFrame], like: Callable[[bytes, bytes], bool],
           agreement: float = 0.0) -> DataFrame:
    """Confirmed links (a, b) between classes (id, bands), enough to tell the components.

    ``items`` gives id and item (binary) for a table of ids; two classes that share a
    band are linked where ``like`` says so of their items. ``agreement`` is the share of
    equal signature values below which ``like`` is not asked.
    """
    each = classes.select("id", F.posexplode("bands").alias("band", "value")).select(
        "id", "band", F.xxhash64("band", "value").alias("key"))
    buckets = each.groupBy("key").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    members = staged(each.join(buckets, "key").select("key", "band", "id", "low"))

    def chosen(ids: DataFrame) -> DataFrame:
        ids = staged(ids.distinct())
        return items(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids)

    # first star: a class meets the lowest class of most of its buckets
    shared = members.filter("id <> low").groupBy("id", "low").agg(F.count(F.lit(1)).alias("n"))
    stars = staged(shared.groupBy(F.col("id").alias("b")).agg(F.max_by("low", F.struct("n", -F.col("low"))).alias("a")))
    links = staged(_confirmed(stars.select("a", "b"), chosen(stars.select(F.col("a").alias("id")).union(stars.select("b"))), like))
    label = components(links)
    members = _mixed_buckets(members.join(label.withColumnRenamed("node", "id"), "id", "left")
                             .select("key", "band", "id", F.coalesce("root", "id").alias("label")))
    pool = staged(chosen(members.select("id")))

    # further stars: a class outside the largest component of a bucket meets another hub of that component
    outside, turn = F.col("label") != F.col("main"), 0
    apart = members.filter(outside).select("id").distinct().count()
    while apart:
        turn += 1
        hubs = members.filter(~outside).groupBy("key").agg(F.min_by("id", F.xxhash64("id", F.lit(turn))).alias("hub"))
        meets = members.filter(outside).join(hubs, "key").groupBy(F.col("id").alias("b"), F.col("hub").alias("a")).agg(
            F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("main").alias("main"))
        meets = meets.groupBy("b").agg(F.max_by(F.struct("a", "label", "main"), F.struct("n", "a")).alias("m")).select(
            "m.a", "b", "m.label", "m.main")
        found = staged(_confirmed(meets, pool, like))
        links = links.union(found.select("a", "b"))
        moved = components(found.select(F.col("label").alias("a"), F.col("main").alias("b")))
        members = _mixed_buckets(members.join(moved.withColumnRenamed("node", "label"), "label", "left").select(
            "key", "band", "id", F.coalesce("root", "label").alias("label")))
        before, apart = apart, members.filter(outside).select("id").distinct().count()
        if STAR_GAIN * (before - apart) < before:
            break
    if not apart:
        return links

    # block step: in buckets of several components, those but the largest meet all others
    few, most = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("few", "most"))
    part = F.when(~outside, -1 - F.pmod(F.xxhash64("id"), most)).otherwise(F.pmod(F.xxhash64("id"), few)).cast("int")
    others = F.sequence(F.lit(0), few - 1)
    meets = F.when(~outside, others).otherwise(
        F.concat(others, F.transform(F.sequence(F.lit(0), most - 1), lambda j: -1 - j)))
    own, other = F.col("part"), F.col("other")
    left = F.when(own < 0, other).when(other < 0, own).otherwise(F.least(own, other))
    right = F.when(own < 0, own).when(other < 0, other).otherwise(F.greatest(own, other))
    blocks = staged(members.withColumn("part", part).withColumn("other", F.explode(meets))
                    .select("key", "band", left.alias("left"), right.alias("right"), "part", "id", "label"))
    rows = (blocks.join(classes.select("id", "bands"), "id").join(pool, "id")
            .repartition("key", "left", "right").sortWithinPartitions("key", "left", "right", "id")
            .select("key", "band", "left", "right", "part", "id", "label", "bands", "item"))
    return links.union(rows.mapInArrow(_across(like, agreement), "a long, b long"))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Rows are linked when 100 times the shared shingles reach 75 times all their
    shingles, confirmed on the full sets. ``component_id`` is the smallest id
    reachable; the row that carries it is kept. Null, empty and blank texts have no
    shingles and no links. Rows that repeat an id are linked as their texts are; a
    null id takes no part in linking, has a null component and is kept. Other
    columns are ignored. An empty table gives no rows.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = staged(sketches(base).withColumn("id", F.monotonically_increasing_id()))
    known = rows.filter("set IS NOT NULL AND doc_id IS NOT NULL")
    # a class is named by the number of one of its rows: a doc_id may have several texts
    least = staged(known.groupBy("set").agg(F.min("id").alias("id"), F.min("doc_id").alias("doc_id")))
    classes = staged(known.select("id", "bands").join(least.select("id"), "id", "left_semi"))
    roots = components(linked(classes, lambda ids: shingle_sets(base, least.join(ids, "id")), alike, LEAST_AGREEMENT))
    named = staged(least.join(roots, least.id == roots.node, "left").select("set", "doc_id", F.coalesce("root", "id").alias("root")))
    smallest = staged(named.groupBy("root").agg(F.min("doc_id").alias("component")))
    found = named.join(smallest, "root").select("set", "component")
    out = rows.join(staged(found), "set", "left")
    own = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"),
                      F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One document of each component, with all its columns."""
    gone = few_keys(staged(near_duplicates(docs, text, doc_id).filter("NOT kept")
                           .select(F.col("doc_id").alias("__id")).distinct()))
    return docs.join(gone, F.col(doc_id) == F.col("__id"), "left_anti")
