"""Secret scans with corpus-wide ownership frequency.

Every whole text is scanned once. The values found are reduced to hashes, and over
the whole corpus each hash is weighed by the number of distinct repositories and
owners that carry it: a value that many owners carry is a copied example, a value
of one owner that looks random is a live credential.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrier.session import staged

#: Kinds in the order in which spans of one start are listed; the last is the method's own.
KINDS = ("assign", "access", "hex", "opaque")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Unlabelled values of the method itself: long runs of mixed letters and digits.
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])")
DIGIT = re.compile(r"[0-9]")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
#: Bits a character at which an unlabelled or live value has to look random.
OPAQUE_BITS, LIVE_BITS = 3.5, 2.5
#: Owners from which on a value is a copied example.
EXAMPLE_OWNERS = 3


def bits_a_character(value: str) -> float:
    """Shannon entropy of the characters of ``value``."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the three base kinds, by start and then kind."""
    found = [(m.start(), 0, m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)
                  if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def opaque_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Random-looking values outside the base spans."""
    found = []
    for m in OPAQUE.finditer(text):
        if (DIGIT.search(m[0]) and not m[0].isdigit() and bits_a_character(m[0]) >= OPAQUE_BITS
                and not any(s < m.end() and m.start() < e for s, _, e, _ in base)):
            found.append((m.start(), 3, m.end(), m[0]))
    return found


CANDIDATE = "array<struct<start:long,kind:int,end:long,value_hash:string,bits:double>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()),
                               ("value_hash", pa.string()), ("bits", pa.float64())]))
    for batch in batches:
        out = []
        for value in batch.column(batch.schema.get_field_index("text")):
            text = value.as_py() or ""
            base = base_spans(text)
            out.append([{"start": s, "kind": k, "end": e, "bits": bits_a_character(v),
                         "value_hash": hashlib.sha256(v.encode("utf-8")).hexdigest()}
                        for s, k, e, v in sorted(base + opaque_spans(text, base))])
        keep = [i for i, name in enumerate(batch.schema.names) if name != "text"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in keep] + [pa.array(out, kind)],
            [batch.schema.names[i] for i in keep] + ["candidates"])


def candidates(docs: DataFrame, repository: Column, owner: Column, text: str = "text",
               doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, repository, owner and the candidates of its whole text (null: none).

    Values leave the scan as SHA-256 only.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), repository.cast("string").alias("repository"),
                       owner.cast("string").alias("owner"), F.col(text).alias("text"))
    kind = dict(base.dtypes)["doc_id"]
    return base.mapInArrow(_scan, f"doc_id {kind}, repository string, owner string, candidates {CANDIDATE}")


def ownership(found: DataFrame) -> DataFrame:
    """value_hash, repositories, owners, documents over the whole corpus.

    Rows are first reduced to distinct (value, repository, owner), combined before
    the shuffle, so a value in a third of all rows is a few rows. A null
    repository or owner counts as one unnamed one.
    """
    each = (found.select("repository", "owner", F.explode("candidates").alias("c"))
            .groupBy(F.col("c.value_hash").alias("value_hash"), "repository", "owner")
            .agg(F.count(F.lit(1)).alias("uses")))
    return each.groupBy("value_hash").agg(
        F.count_distinct(F.struct("repository")).alias("repositories"),
        F.count_distinct(F.struct("owner")).alias("owners"), F.sum("uses").alias("uses"))


def scan(docs: DataFrame, repository: Column, owner: Column, text: str = "text",
         doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id and ``spans``, an array of the spans that count.

    A span has start, end (code points, end exclusive), kind, repositories, owners and
    a ``verdict``: ``example`` (``EXAMPLE_OWNERS`` or more owners carry the value),
    ``live`` (fewer, and it looks random), else ``weak``. Base kinds always stay;
    unlabelled values stay only when live. Null text and texts without a find have
    an empty array. Repeated rows each give their row.
    """
    found = staged(candidates(docs, repository, owner, text, doc_id).withColumn("row", F.monotonically_increasing_id()))
    weigh = staged(ownership(found))
    span = found.select("row", F.explode("candidates").alias("c")).select("row", "c.*").join(weigh, "value_hash")
    verdict = (F.when(F.col("owners") >= EXAMPLE_OWNERS, "example")
               .when(F.col("bits") >= LIVE_BITS, "live").otherwise("weak"))
    names = F.array(*map(F.lit, KINDS))
    spans = (span.withColumn("verdict", verdict)
             .filter((F.col("kind") < 3) | (F.col("verdict") == "live"))
             .groupBy("row").agg(F.sort_array(F.collect_list(F.struct(
                 "start", "kind", "end", F.element_at(names, F.col("kind") + 1).alias("name"),
                 "value_hash", "repositories", "owners", "verdict"))).alias("spans")))
    none = F.array().cast(spans.schema["spans"].dataType)
    return (found.select("doc_id", "row").join(spans, "row", "left")
            .select("doc_id", F.coalesce("spans", none).alias("spans")))
