"""Fingerprints by randomised edit embedding.

A shared random walk reads a text: at every step it emits the character it stands
on and a random bit, drawn for this step and character, says whether it moves on.
Texts a few edits apart soon walk in step again, so edit distance becomes Hamming
distance of what is emitted. A fingerprint samples one bit of the emitted character
at shared random steps, at the scale of the text's length and at twice that scale,
so texts whose lengths differ less than a scale can be compared.

All texts of a batch walk at once, one numpy step for all of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrier.llm.common import text_of
from terrier.llm.components import components
from terrier.llm.near_dedup import linked
from terrier.session import staged

#: Sampled bits at one scale; characters that walk at once.
BITS, WALK_CHARS = 256, 12_000_000
#: Bands of a fingerprint at one scale, and bits of a band.
BANDS, BAND_BITS = 24, 16
#: Ranges of ids dealt out for each shuffle partition.
RANGES = 8
SEED = 20_11


def _draw(kind: int, *key: int) -> np.random.Generator:
    return np.random.default_rng([SEED, kind, *key])


def _steps(scale: int) -> np.ndarray:
    """Sorted sampled steps of a scale; walks of texts of 2 ** scale characters take twice as many."""
    return np.sort(_draw(1, scale).integers(0, 2 << scale, BITS))


def _bit_table(scale: int) -> np.ndarray:
    """The bit of each character class at each sampled step."""
    return _draw(2, scale).integers(0, 2, (BITS, 256)).astype(np.uint8)


def _moves(block: int, size: int) -> np.ndarray:
    """Whether the walk moves on, by step of a block and character class; class 0 is the end."""
    masks = _draw(3, block).integers(0, 1 << 63, size, np.uint64)
    classes = _draw(4).integers(0, 1 << 63, 256, np.uint64)
    moves = (np.bitwise_count(masks[:, None] & classes[None, :]) & 1).astype(np.intp)
    moves[:, 0] = 0
    return moves


def _classes(text: str) -> np.ndarray:
    """Code points dealt to 255 classes, and the end."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    mixed = (codes * np.uint32(2654435761)) >> np.uint32(8)
    return np.append(mixed % 255 + 1, 0).astype(np.uint8)


def fingerprints(texts: list[str]) -> list[str]:
    """A fingerprint of each whole text: scale, then twice (bits inside the walk, bits in hex)."""
    lengths = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    parts = [_classes(texts[i]) for i in order]
    chars = np.concatenate(parts or [np.empty(0, np.uint8)])
    sizes = np.array([len(p) for p in parts], np.int64)
    place = np.cumsum(sizes) - sizes
    end = place + sizes - 1
    scales = np.array([max(int(n) - 1, 0).bit_length() for n in sizes - 1])
    seen = np.zeros((2, len(texts), BITS), np.uint8)
    events = []
    for scale in set(scales.tolist()) | set((scales + 1).tolist()):
        for way in (0, 1):  # a text records at its own scale and at the next
            lanes = np.flatnonzero(scales == scale - way)
            if len(lanes):
                events += [(int(step), way, k, int(lanes[0]), int(lanes[-1]) + 1)
                           for k, step in enumerate(_steps(scale))]
    events.sort()
    at, block, width = 0, 0, 512
    walking = np.flatnonzero(sizes > 1)
    here = place[walking]
    step = 0
    while len(walking) and at < len(events):
        for moves in _moves(block, width):
            now = chars[here]
            while at < len(events) and events[at][0] == step:
                _, way, k, first, last = events[at]
                a, b = np.searchsorted(walking, (first, last))
                seen[way, walking[a:b], k] = now[a:b]
                at += 1
            here += moves[now]
            step += 1
        block += 1
        left = here < end[walking]
        walking, here = walking[left], here[left]
    out = [""] * len(texts)
    tables: dict[int, np.ndarray] = {}
    for lane, i in enumerate(order.tolist()):
        said = [f"{scales[lane]:02x}"]
        for way in (0, 1):
            scale = int(scales[lane]) + way
            if scale not in tables:
                tables[scale] = _bit_table(scale)
            found = seen[way, lane]
            bits = tables[scale][np.arange(BITS), found] * (found > 0)
            said.append(f"{np.count_nonzero(found):03x}:{np.packbits(bits).tobytes().hex()}")
        out[i] = ":".join(said)
    return out


def _parsed(fingerprint: str) -> tuple[int, list[tuple[int, np.ndarray]]]:
    scale, n, bits, m, more = fingerprint.split(":")
    def unpack(text: str) -> np.ndarray:
        return np.unpackbits(np.frombuffer(bytes.fromhex(text), np.uint8))
    return int(scale, 16), [(int(n, 16), unpack(bits)), (int(m, 16), unpack(more))]


def likeness(one: str, other: str) -> float:
    """0 to 1: how far the bits agree beyond chance, at the larger of both scales.

    Bits where only one text still walks disagree by half; equal fingerprints give
    1, scales that are more than one apart give 0.
    """
    if one == other:
        return 1.0
    (a, left), (b, right) = _parsed(one), _parsed(other)
    scale = max(a, b)
    if abs(a - b) > 1:
        return 0.0
    (n, x), (m, y) = left[scale - a], right[scale - b]
    both = min(n, m)
    if not max(n, m):
        return 0.0
    agree = np.count_nonzero(x[:both] == y[:both])
    return max(0.0, (2.0 * agree - both) / max(n, m))


def bands(fingerprint: str) -> list[int]:
    """Band keys: sampled bits among those inside the walk, at both scales; [] of an empty text."""
    scale, both = _parsed(fingerprint)
    out = []
    for way, (n, bits) in enumerate(both):
        if n:
            # by share of the walk, rounded so that nearly equal walks pick the same bits
            picks = _draw(5).integers(0, 1 << 30, (BANDS, BAND_BITS)) % max(1, n - n % 8)
            keys = np.packbits(bits[picks], axis=1)
            out += [int.from_bytes(hashlib.blake2b(bytes([scale + way, b]) + k.tobytes(), digest_size=8).digest(), "big", signed=True)
                    for b, k in enumerate(keys)]
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come range by range in descending order, each range closed by the row after it."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
             "bands_edited"]

    def compared(rows: list[tuple]) -> pa.RecordBatch:
        own = [(a, b) for a, b in zip(rows, rows[1:]) if not a[1]]
        texts = list(dict.fromkeys([r[3] for r in rows]))
        edited = [a[3][: len(a[3]) - len(a[3]) // 2] + b[3][: len(a[3]) // 2] for a, b in own]
        prints = fingerprints(texts + edited)
        known = dict(zip(texts, prints))
        out = []
        for (a, b), text, print_ in zip(own, edited, prints[len(texts):]):
            mine = known[a[3]]
            out.append((a[2], len(a[3]), hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(), mine, print_,
                        likeness(mine, print_), likeness(mine, known[b[3]]),
                        len(set(bands(mine)) & set(bands(print_)))))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 8, kinds)], names)

    held, chars = [], 0
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            held.append(row)
            chars += 2 * len(row[3])
            if chars >= WALK_CHARS:
                yield compared(held)
                held, chars = held[-1:], 0
    if held:
        yield compared(held)


def beside_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) in ranges of descending ids, each closed by its successor.

    Columns: range, closing, doc_id, text. Ids are cut at approximate quantiles. A
    range ends with a copy of the first row of the next range that has rows; the
    last range with one of the very first row. Texts move once. Null ids come last.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col("doc_id").cast("double").alias("id"))
    cuts = sorted(set(ids.approxQuantile("id", [i / (RANGES * parts) for i in range(1, RANGES * parts)], 0.25 / (RANGES * parts))))
    splits = [float("-inf"), *cuts, float("inf")]
    lowest = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-1.7e308")))
    if len(splits) > 2:
        docs = Bucketizer(splits=splits, inputCol="__id", outputCol="range").transform(docs.withColumn("__id", lowest)).drop("__id")
    else:
        docs = docs.withColumn("range", F.lit(0.0))
    firsts = docs.groupBy("range").agg(F.max("doc_id").alias("first")).orderBy(F.col("range").desc()).collect()  # one a range
    after = [(here.range, then.first) for here, then in zip(firsts, firsts[1:] + firsts[:1])]
    closing = spark.createDataFrame(after, "into double, first long")
    copies = docs.join(F.broadcast(closing), F.col("doc_id").eqNullSafe(F.col("first"))).select(
        F.col("into").alias("range"), F.lit(1).alias("closing"), "doc_id", "text")
    return (docs.select("range", F.lit(0).alias("closing"), "doc_id", "text").unionByName(copies)
            .repartition(parts, "range").sortWithinPartitions("range", "closing", F.col("doc_id").desc_nulls_last(), "text"))


def fingerprint_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprint of every whole text and of its edited text, and their likeness.

    The edited text is the text with its last half (rounded down) replaced by as many
    first characters of the next document by descending id, or all of it; after the
    last comes the first. Null text counts as empty; null ids come last; rows with
    one id follow each other by text. ``bands_edited`` counts the bit-sampled bands
    the two share. An empty table gives no rows.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return beside_next(base).mapInArrow(_compare, (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, bands_edited long"))


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = fingerprints([t or "" for t in batch.column(1).to_pylist()])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(prints), pa.array([bands(p) for p in prints], pa.list_(pa.int64()))],
            ["id", "fingerprint", "bands"])


def similar_documents(docs: DataFrame, least: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and component_id: documents linked where bands meet and the likeness is ``least`` or more.

    Null and empty texts are linked with nothing; rows with a null id are left out.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("id"), text_of(text).alias("text")).filter("id IS NOT NULL")
    prints = staged(base.mapInArrow(_printed, "id long, fingerprint string, bands array<long>"))
    least_id = prints.groupBy("fingerprint").agg(F.min("id").alias("first"))
    classes = staged(prints.groupBy("fingerprint").agg(F.min("id").alias("id"), F.any_value("bands").alias("bands"))
                     .filter(F.size("bands") > 0))
    known = classes.select("id", "fingerprint")

    def like(one: bytes, other: bytes) -> bool:
        return likeness(one.decode(), other.decode()) >= least

    def items(ids: DataFrame) -> DataFrame:
        return known.join(ids, "id", "left_semi").select("id", F.col("fingerprint").cast("binary").alias("item"))
    roots = components(linked(classes, items, like))
    out = prints.join(least_id, "fingerprint").join(roots, F.col("first") == F.col("node"), "left")
    empty = F.size("bands") == 0
    return out.select(F.col("id").alias("doc_id"), F.when(empty, F.col("id")).otherwise(F.coalesce("root", "first")).alias("component_id"))
