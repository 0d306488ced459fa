"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Targets: sources begin at their share by weight; those above their cap (maximum
epochs times their size) are clamped and what they leave goes to the others by
weight, round after round, until none is above.

Sampling: a source's target is some whole repetitions of all its documents and a
fraction of one more. The fraction is a seeded random order of the source's
documents up to a cut. The cut is found from sums over two levels of hash
buckets, so no task ever holds or sorts a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrier.llm.common import WORD, text_of
from terrier.session import staged

#: Hex digits of the order key that make one level of buckets: 4096 buckets.
LEVEL = 3


def word_count(text: str = "text"):
    """Words of a text, null as empty."""
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def ranked(sources: DataFrame, column: str) -> DataFrame:
    """``sources`` with ``rank`` from 0, by code point, null last; no task ranks all of them.

    Ranges of sources are ranked apart; the ranges before add their numbers.
    """
    spark = sources.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(sources.repartitionByRange(parts, F.col(column).asc_nulls_last())
                    .withColumn("range", F.spark_partition_id()))
    before = (ranged.groupBy("range").count()
              .withColumn("before", F.sum("count").over(Window.orderBy("range")) - F.col("count"))
              .select("range", "before"))  # one row for each range
    own = F.row_number().over(Window.partitionBy("range").orderBy(F.col(column).asc_nulls_last()))
    return (ranged.withColumn("own", own).join(F.broadcast(before), "range")
            .withColumn("rank", F.col("own") - 1 + F.col("before")).drop("range", "own", "before"))


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``.

    A source whose weight is null or not above zero, or whose size is zero, gets 0.
    Where even all caps together are below ``total``, each source gets its cap.
    One aggregated row comes to the driver each round.
    """
    table = staged(sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
                   .withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))))
    level, clamped = 0.0, -1
    while True:
        above = F.col("weight") * F.lit(level) >= F.col("cap")
        row = table.select(above.alias("above"), "weight", "cap").agg(
            F.count_if("above").alias("n"),
            F.sum(F.when(F.col("above"), F.col("cap")).otherwise(0.0)).alias("used"),
            F.sum(F.when(~F.col("above"), F.col("weight")).otherwise(0.0)).alias("open")).first()
        if row["n"] == clamped or not row["open"]:
            if not row["open"]:
                level = float("inf")
            break
        clamped, level = row["n"], max(level, (total - row["used"]) / row["open"])
    share = F.when(F.col("weight") > 0, F.least(F.col("weight") * F.lit(level), F.col("cap"))).otherwise(0.0)
    return table.withColumn("target", F.round(share, 6)).drop("cap")


def _cut(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """For each source the last order key that its fractional repetition takes.

    ``docs``: source, size, key, doc_id; ``sources``: source, rest (words wanted).
    """
    same = F.col("s.source").eqNullSafe(F.col("d.source"))
    found = sources.select("source", F.lit("").alias("prefix"), "rest")
    for level in (1, 2):
        width = level * LEVEL
        inside = (docs.alias("d").join(found.alias("s"), [same, F.substring("d.key", 1, width - LEVEL) == F.col("s.prefix")])
                  .select("d.source", F.substring("d.key", 1, width).alias("prefix"), "d.size", "s.rest")
                  .groupBy("source", "prefix", "rest").agg(F.sum("size").alias("size")))
        run = F.sum("size").over(Window.partitionBy("source").orderBy("prefix"))
        found = staged(inside.withColumn("run", run)
                       .filter((F.col("run") > F.col("rest")) & (F.col("run") - F.col("size") <= F.col("rest")))
                       .select("source", "prefix", (F.col("rest") - F.col("run") + F.col("size")).alias("rest")))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size")
    return (docs.alias("d").join(found.alias("s"), [same, F.substring("d.key", 1, 2 * LEVEL) == F.col("s.prefix")])
            .select("d.source", "d.key", "d.doc_id", "d.size", "s.prefix", "s.rest")
            .withColumn("run", F.sum("size").over(order))
            .groupBy("source").agg(
                F.max(F.when(F.col("run") - F.col("size") / 2 <= F.col("rest"),
                             F.struct("key", "doc_id", "size"))).alias("cut"),
                F.max("prefix").alias("prefix"))
            .select("source", F.coalesce("cut", F.struct(
                F.col("prefix").alias("key"), F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"),
                F.lit(None).cast("long").alias("size"))).alias("cut")))


def contract_weights(sources: DataFrame) -> DataFrame:
    """Weights 3, 1, 2, repeating, over the sources by code point, null last."""
    turn = F.col("rank") % 3
    return ranked(sources, "source").withColumn(
        "weight", F.when(turn == 0, 3.0).when(turn == 1, 1.0).otherwise(2.0)).drop("rank")


def _key(seed: str, doc_id: str) -> Column:
    """The random place of a document in its source's order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))).cast("binary"))


def draws(docs: DataFrame, weights=contract_weights, share: float = 1.5, max_epochs: float = 2.0,
          seed: str = "mix", text: str = "text", doc_id: str = "doc_id", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, source, size, key) and what each source draws.

    The second table has source, source_size, target, whole repetitions, and the last
    (key, doc_id, size) that the fractional repetition takes, null for none.
    """
    base = staged(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                              word_count(text).alias("size"), _key(seed, doc_id).alias("key")))
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    total = base.agg(F.sum("size")).first()[0] or 0
    targets = water_fill(weights(sizes), share * total, max_epochs)
    whole = F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0)).cast("long")
    plan = staged(targets.withColumn("whole", whole)
                  .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    cuts = _cut(base, plan.filter("rest > 0").select("source", "rest"))
    plan = staged(plan.alias("p").join(cuts.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left")
                  .select("p.source", "p.source_size", "p.target", "p.whole", "c.cut"))
    return base, plan


def mix(docs: DataFrame, **options) -> DataFrame:
    """How often each document is taken: doc_id, source, size, source_size, target, times, taken.

    The options are those of ``draws``: ``weights`` turns a table of ``source`` and
    ``source_size`` into one with ``weight`` beside; the mix wants ``share`` times all
    words. Null text has no words; a null source is a source of its own. Rows that
    repeat id and size are drawn together. A document that holds the cut is taken where
    that brings the source nearer to its target. An empty table gives no rows.
    """
    base, plan = draws(docs, **options)
    extra = F.coalesce(F.struct("d.key", "d.doc_id", "d.size") <= F.col("p.cut"), F.lit(False)).cast("long")
    times = F.col("p.whole") + extra
    return (base.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
            .select("d.doc_id", "d.source", "d.size", "p.source_size", "p.target",
                    times.alias("times"), (times * F.col("d.size")).alias("taken")))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with all its columns.

    Documents without words add nothing to a target; their source's draw holds for
    them too. Texts are not moved: each row meets its source's draw alone.
    """
    doc_id, source, text = (options.get(c, c) for c in ("doc_id", "source", "text"))
    _, plan = draws(docs, **options)
    plan = plan.select(F.col("source").alias("__source"), "whole", "cut").withColumnsRenamed({"whole": "__whole", "cut": "__cut"})
    own = F.struct(_key(options.get("seed", "mix"), doc_id).alias("key"), F.col(doc_id).alias("doc_id"),
                   word_count(text).alias("size"))
    times = F.col("__whole") + F.coalesce(own <= F.col("__cut"), F.lit(False)).cast("long")
    copies = F.explode(F.when(F.col("__times") > 0, F.sequence(F.lit(1), F.col("__times").cast("int"))))
    return (docs.join(plan, F.col(source).eqNullSafe(F.col("__source"))).withColumn("__times", times)
            .select(*docs.columns, copies.alias("__copy")).drop("__copy"))
