"""Near duplicates by SimHashes at most two bits apart, searched in BK-trees.

A fingerprint has a bit for each bit of the 64-bit hashes of a text's word shingles,
set if it is set in over half of them. Different fingerprints are the nodes of the graph.

* Shards. Two fingerprints that differ in ``RADIUS`` bits agree in one of ``RADIUS + 1``
  runs of bits, so each goes to as many shards, named by run and value. A shard of more
  than ``SHARD`` fingerprints is dealt out again by runs of the bits that are left, which
  is as exact; with 12 bits left none is that large.
* Each shard is one BK-tree, built in the task that the shuffle brings it to: a child
  hangs on its parent by their Hamming distance, and a search follows only the edges
  within the radius of its own distance. Trees reach their searches by the shuffle and
  not by a broadcast, since together they hold the fingerprints of all documents.
* A search that finds what is already connected in its tree says nothing, so a shard of
  n fingerprints yields n - 1 links at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrier.llm.common import few_keys, words_of
from terrier.llm.components import components
from terrier.session import staged

#: Words of a shingle, seed of the hash, and bits in which linked fingerprints may differ.
SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints of one tree; a power of two.
SHARD = 1 << 12
#: Shingles whose bits are counted at once.
SLICE = 1 << 14


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The unsigned SimHash of a whole text; zero without words, one shingle with fewer than ``size``."""
    words = words_of(text or "")
    if not words:
        return 0
    joined, width = b" ".join(words), min(size, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths).tolist(), ends[width - 1:].tolist()
    hashed, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(ends), SLICE):
        run = [hashed(joined[s:e], SEED) for s, e in zip(starts[at: at + SLICE], ends[at: at + SLICE])]
        bits = np.unpackbits(np.array(run, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(ends), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "bits"])


class Tree:
    """A BK-tree of integers: children by their Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        node = len(self.values)
        self.values.append(value)
        self.children.append({})
        at = 0
        while at != node:
            at = self.children[at].setdefault((value ^ self.values[at]).bit_count(), node)

    def near(self, value: int, radius: int) -> list[int]:
        """Numbers of the values within the radius, by order of insertion of their branch."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            distance = (value ^ self.values[at]).bit_count()
            if distance <= radius:
                found.append(at)
            children = self.children[at]
            if len(children) > 2 * radius + 1:
                todo += [children[d] for d in range(distance - radius, distance + radius + 1) if d in children]
            else:
                todo += [c for d, c in children.items() if abs(d - distance) <= radius]
        return found


def tree_links(values: list[int], radius: int = RADIUS) -> Iterator[tuple[int, int]]:
    """Pairs within the radius that connect all that are connected by such pairs."""
    tree, parent = Tree(), list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, value in enumerate(values):
        for j in tree.near(value, radius):
            a, b = root(i), root(j)
            if a != b:
                parent[a] = b
                yield values[j], value
        tree.add(value)


def _shard_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each shard; rows (key, bits) come sorted, and a shard is at most ``SHARD`` of them."""
    def links(run: list[int]) -> pa.RecordBatch | None:
        found = list(tree_links([b & 0xFFFFFFFFFFFFFFFF for b in run])) if len(run) > 1 else []
        ends = np.array(found, np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"]) if found else None

    key, run = None, []
    for batch in batches:
        for k, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key:
                if (out := links(run)) is not None:
                    yield out
                key, run = k, []
            run.append(bits)
    if (out := links(run)) is not None:
        yield out


def _runs(bits: list[int]) -> list[list[int]]:
    """The bits in ``RADIUS + 1`` runs of about one length."""
    return [list(map(int, run)) for run in np.array_split(np.array(bits, np.int64), RADIUS + 1)]


def _dealt(rows: DataFrame, paths: dict[str, list[int]]) -> tuple[DataFrame, dict[str, list[int]]]:
    """Rows (bits, key, path) to one shard for each run of the bits their path has left."""
    after, choices = {}, []
    for path, left in paths.items():
        for i, run in enumerate(_runs(left)):
            after[f"{path}{i}"] = [b for b in left if b not in run]
            mask = sum(1 << b for b in run)
            choices += [(path, f"{path}{i}", mask - (1 << 64) if mask >> 63 else mask)]
    pairs = [x for p in paths for x in (F.lit(p), F.array(*[
        F.struct(F.lit(to).alias("path"), F.lit(mask).cast("long").alias("mask")) for of, to, mask in choices if of == p]))]
    dealt = rows.select("bits", "key", F.explode(F.create_map(*pairs)[F.col("path")]).alias("to"))
    return dealt.select("bits", F.xxhash64("key", "to.path", F.col("bits").bitwiseAND(F.col("to.mask"))).alias("key"),
                        F.col("to.path").alias("path")), after


def links(fingerprints: DataFrame, shard: int = SHARD) -> DataFrame:
    """Links (a, b) between different ``bits`` within the radius, enough to tell the components."""
    rows, paths, found = fingerprints.select("bits", F.lit(0).cast("long").alias("key"), F.lit("").alias("path")), {"": list(range(64))}, None
    while True:
        dealt, paths = _dealt(rows, paths)
        dealt = staged(dealt)
        sizes = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        large = staged(sizes.filter(F.col("n") > shard).select("key"))
        more = not large.isEmpty()
        fit = dealt.join(few_keys(large), "key", "left_anti") if more else dealt
        made = fit.repartition("key").sortWithinPartitions("key", "bits").select("key", "bits").mapInArrow(
            _shard_links, "a long, b long")
        found = made if found is None else found.unionByName(made)
        if not more:
            return found
        rows = dealt.join(few_keys(large), "key", "left_semi")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Rows are linked when their fingerprints differ in two bits or fewer; component_id is
    the smallest doc_id reachable, itself included. Null, empty and blank texts have the
    fingerprint zero and are linked like any other. A null doc_id links as its text does;
    its component is null only if no other row is reachable. Repeated rows and ids are rows
    of their own. Other columns are ignored. An empty table gives no rows.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = staged(base.mapInArrow(_fingerprints, "doc_id long, bits long"))
    nodes = staged(rows.groupBy("bits").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes))
    rooted = staged(nodes.join(roots.withColumnRenamed("node", "bits"), "bits", "left")
                    .select("bits", "least", F.coalesce("root", "bits").alias("root")))
    least = staged(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    found = staged(rooted.join(least, "root").select("bits", "component_id"))
    return rows.join(found, "bits").select(
        "doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")
