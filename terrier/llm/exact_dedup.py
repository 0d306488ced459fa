"""Exact duplicates by counting quotient filters and byte verification.

1. Each task builds one counting quotient filter over the 64-bit fingerprints of
   its rows. A fingerprint is cut into segment, quotient and remainder; a filter
   holds, per segment, an occupied bit per quotient, a run-end bit per slot, and
   sorted remainders with their counts. Whole fingerprints can be read back from
   it, so it is an exact multiset of them.
2. Filters of one segment meet in one task and merge by their sorted remainders;
   counts add up, nothing is lost. Segments are as many as the rows ask for.
3. Fingerprints counted more than once route their rows to byte verification:
   a grouping by the text itself, combined before the shuffle, so a text held by
   a third of all rows is one row for each task.

Rows with a count of one never move their text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrier.llm.common import few_keys, text_of
from terrier.session import staged

#: Fingerprints a merged segment should hold, and bits of a quotient within a segment.
SEGMENT_ROWS, QUOTIENT_BITS = 1 << 15, 12
#: Fingerprints a task gathers before it closes a filter and begins the next.
FILTER_ROWS = 1 << 20

SEGMENTS = ("segment long, occupied binary, run_ends binary, remainders binary, counts binary")


@dataclass
class QuotientFilter:
    """One segment of a counting quotient filter, with ``bits`` for quotient and remainder."""

    bits: int
    occupied: np.ndarray
    run_ends: np.ndarray
    remainders: np.ndarray
    counts: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray, counts: np.ndarray, bits: int) -> QuotientFilter:
        """From sorted distinct ``keys`` of ``bits`` bits."""
        shift = np.uint64(bits - QUOTIENT_BITS)
        quotients = (keys >> shift).astype(np.int64)
        occupied = np.zeros(1 << QUOTIENT_BITS, bool)
        occupied[quotients] = True
        ends = np.append(quotients[1:] != quotients[:-1], True)[: len(keys)]
        return cls(bits, occupied, ends, keys & ((np.uint64(1) << shift) - np.uint64(1)), counts)

    def keys(self) -> np.ndarray:
        """The keys, sorted: the k-th run belongs to the k-th occupied quotient."""
        run = np.concatenate([[0], np.cumsum(self.run_ends)[:-1]]).astype(np.int64)
        quotients = np.flatnonzero(self.occupied)[run].astype(np.uint64)
        return (quotients << np.uint64(self.bits - QUOTIENT_BITS)) | self.remainders

    def pack(self) -> tuple[bytes, bytes, bytes, bytes]:
        return (np.packbits(self.occupied).tobytes(), np.packbits(self.run_ends).tobytes(),
                self.remainders.tobytes(), self.counts.tobytes())

    @classmethod
    def unpack(cls, bits: int, occupied: bytes, run_ends: bytes, remainders: bytes,
               counts: bytes) -> QuotientFilter:
        rest = np.frombuffer(remainders, np.uint64)
        def flags(data: bytes, n: int) -> np.ndarray:
            return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)
        return cls(bits, flags(occupied, 1 << QUOTIENT_BITS), flags(run_ends, len(rest)), rest,
                   np.frombuffer(counts, np.int64))

    @classmethod
    def merge(cls, filters: list[QuotientFilter]) -> QuotientFilter:
        """The sum of filters over the same segment; every key and count is kept."""
        keys = np.concatenate([f.keys() for f in filters])
        counts = np.concatenate([f.counts for f in filters])
        order = np.argsort(keys, kind="stable")  # runs are sorted already: a merge
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return cls.build(keys[first], np.add.reduceat(counts, first), filters[0].bits)


def _builder(segment_bits: int):
    bits = 64 - segment_bits

    def filters(chunks: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(chunks), return_counts=True)
        segments = (keys >> np.uint64(bits)) if segment_bits else np.zeros_like(keys)
        own = keys & np.uint64((1 << bits) - 1)
        starts = np.flatnonzero(np.append(True, segments[1:] != segments[:-1]))
        rows = [(int(segments[a]), *QuotientFilter.build(own[a:b], counts[a:b], bits).pack())
                for a, b in zip(starts, np.append(starts[1:], len(keys)))]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] + [pa.binary()] * 4)],
            ["segment", "occupied", "run_ends", "remainders", "counts"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, held = [], 0
        for batch in batches:
            chunks.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            held += batch.num_rows
            if held >= FILTER_ROWS:
                yield filters(chunks)
                chunks, held = [], 0
        if held:
            yield filters(chunks)
    return build


def _merger(segment_bits: int):
    bits = 64 - segment_bits

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        parts = [QuotientFilter.unpack(bits, *row) for row in zip(*(
            table.column(c).to_pylist()
            for c in ("occupied", "run_ends", "remainders", "counts")))]
        whole = QuotientFilter.merge(parts)
        segment = np.uint64(key[0].as_py() << bits) if segment_bits else np.uint64(0)
        keys = (whole.keys() | segment).view(np.int64)
        return pa.table({"fingerprint": pa.array(keys), "copies": pa.array(whole.counts)})
    return merge


def fingerprint_counts(fingerprints: DataFrame) -> DataFrame:
    """Counts of a column of 64-bit fingerprints, by merged quotient filters.

    ``fingerprints`` has one bigint column without nulls. Returns ``fingerprint``
    and ``copies``; an empty table gives no rows.
    """
    rows = fingerprints.count()
    segment_bits = max(0, (rows // SEGMENT_ROWS).bit_length())
    return (fingerprints.mapInArrow(_builder(segment_bits), SEGMENTS)
            .groupBy("segment").applyInArrow(_merger(segment_bits), "fingerprint long, copies long"))


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row with the document that stays for its text.

    Of equal texts the largest id stays. Null text is equal to empty text; a null
    id ranks below every id. Rows that repeat both id and text are rows of their own,
    alike in all columns, and ``group_size`` counts them. Other columns are ignored.
    An empty table gives no rows.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    base = base.withColumn("fingerprint", F.xxhash64("text"))
    repeated = few_keys(staged(fingerprint_counts(base.select("fingerprint"))
                               .filter("copies > 1").select("fingerprint")))
    digest = F.sha2(F.col("text"), 256).alias("text_sha256")
    texts = (base.join(repeated, "fingerprint", "left_semi")
             .groupBy("text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    # a digest that two verified texts shared would need another key: say so, never guess
    classes = (texts.select(digest, F.xxhash64("text").alias("fingerprint"), "keep_id", "group_size")
               .groupBy("fingerprint", "text_sha256")
               .agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"),
                    F.count(F.lit(1)).alias("texts")))
    light = base.select("doc_id", "fingerprint", digest)
    lone = F.col("texts").isNull()
    size = F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a SHA-256 digest"))
                  .cast("long")).otherwise(F.col("group_size"))
    out = light.join(staged(classes), ["fingerprint", "text_sha256"], "left").select(
        "doc_id", F.when(lone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(lone, F.lit(1).cast("long")).otherwise(size).alias("group_size"), "text_sha256")
    return out.select("doc_id", "keep_id", "group_size",
                      F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that stay, with all their columns; of rows that repeat id and text, one."""
    sha = F.unhex(F.sha2(text_of(text), 256))
    found = staged(exact_duplicates(docs, text, doc_id).filter("group_size > 1").select(
        F.col("doc_id").alias("__id"), F.unhex("text_sha256").alias("__sha"), "kept").distinct())
    key = [F.col(doc_id).eqNullSafe(F.col("__id")), sha == F.col("__sha")]
    gone, kept = (few_keys(staged(found.filter(f).drop("kept"))) for f in ("NOT kept", "kept"))
    rest = docs.join(gone, key, "left_anti")
    # a kept row can itself be there several times; only such rows are compared again
    ties = few_keys(staged(rest.select(doc_id, text).join(kept, key).groupBy("__id", "__sha").count()
                           .filter("count > 1").drop("count")))
    if ties.isEmpty():
        return rest
    single = (rest.join(ties, key, "left_semi")
              .withColumn("__sha", sha).dropDuplicates([doc_id, "__sha"]).drop("__sha"))
    return rest.join(ties, key, "left_anti").unionByName(single)
