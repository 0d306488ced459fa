"""The registered text queries and, where SQL can say them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from terrier.llm import (
    bpe,
    edit_fingerprint,
    exact_dedup,
    language_id,
    language_model,
    line_dedup,
    mixing,
    near_dedup,
    quality,
    secrets,
)
from terrier.llm.common import held_out
from terrier.llm.corpus_queries import OP12_SQL, op12_collocations, op13_simhash_dedup
from terrier.llm.turn_queries import OP11_SQL, op11_conversation_repair
from terrier.queries.tables import Query

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LABELS = "doc_id bigint, quality int, toxic int"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(DOCUMENTS).parquet(f"{folder}/documents.parquet")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(LABELS).parquet(f"{folder}/labels.parquet")


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token digests of every whole text and of what its tokens decode to."""
    docs = documents(spark, folder)
    codec = bpe.Codec(spark, bpe.vocabulary_path()).fit_lexicon(docs)
    encoded = codec.encode(docs.select("doc_id", "text"), drop=("text",), decoded="decoded")
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op2_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the document that stays for its text."""
    return exact_dedup.exact_duplicates(documents(spark, folder))


OP2_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of every document, and which of them repeat an earlier one closely."""
    found = line_dedup.document_lines(documents(spark, folder))
    removed = F.array_join(F.col("removed").cast("array<string>"), ",")
    return found.select("doc_id", "n_lines", "n_kept", F.sha2(removed, 256).alias("removed_sha256"))


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of every document the mix takes."""
    return mixing.mix(documents(spark, folder)).select(
        "doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * sum(size) AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
           WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM docs GROUP BY source),
steps AS (
  SELECT cap / weight AS ratio,
         (1.5::DOUBLE * (SELECT sum(source_size) FROM sources)
          - coalesce(sum(cap) OVER before, 0)) / sum(weight) OVER after AS level
  FROM sources
  WINDOW before AS (ORDER BY cap / weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         after AS (ORDER BY cap / weight ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
targets AS (
  SELECT source, source_size,
         round(least(cap, weight * (SELECT arg_min(level, ratio) FROM steps WHERE level <= ratio)), 6) AS target
  FROM sources),
plan AS (
  SELECT *, CAST(coalesce(floor(target / nullif(source_size, 0)), 0) AS BIGINT) AS whole FROM targets),
runs AS (
  SELECT d.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size) AS run
  FROM docs d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN rest > 0 AND run - size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT)
         AS taken
FROM runs
"""


def op5_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the smallest id among its near copies."""
    return near_dedup.near_duplicates(documents(spark, folder))


OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id
  GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least_id AS component_id, d.doc_id = least_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS least_id FROM reach GROUP BY a) USING (doc_id)
"""


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Expected grade of every document, and whether it is likely good."""
    docs = documents(spark, folder)
    model = quality.train(docs, quality.graded(labels(spark, folder)))
    return quality.rate(docs, model, ["doc_id"], wanted=2).withColumn(
        "kept", F.col("tail_probability") >= quality.KEEP_FROM)


def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Edit fingerprints of every document and of its edited text."""
    return edit_fingerprint.fingerprint_documents(documents(spark, folder))


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    docs = documents(spark, folder)
    model = language_id.train(docs.filter(~held_out(4)))
    return language_id.identify(docs, model, ["doc_id", held_out(4).alias("held_out")])


def op10_language_model(spark: SparkSession, folder: str) -> DataFrame:
    """Log10 probability of every document, learned from six sevenths of them."""
    docs = documents(spark, folder)
    model = language_model.train(docs.filter(~held_out(7)))
    return language_model.score(docs, model, ["doc_id", held_out(7).alias("held_out")])


def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document; a source is an owner and each of its documents a repository."""
    owner = F.col("source")
    repository = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    found = secrets.scan(documents(spark, folder), repository, owner)

    def number(kind: int):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    def said(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"),
        F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["verdict"] == "live")).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: s["verdict"] == "example")).cast("long").alias("n_example"))


QUERIES: dict[str, Query] = {
    "op1_bpe": Query(op1_bpe),
    "op2_exact_dedup": Query(op2_exact_dedup, OP2_SQL),
    "op3_line_dedup": Query(op3_line_dedup),
    "op4_mixing": Query(op4_mixing, OP4_SQL),
    "op5_near_dedup": Query(op5_near_dedup, OP5_SQL),
    "op6_quality": Query(op6_quality),
    "op7_fingerprints": Query(op7_fingerprints),
    "op8_language_id": Query(op8_language_id),
    "op9_secrets": Query(op9_secrets),
    "pipeline": Query(corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
    "op10_language_model": Query(op10_language_model),
    "op11_conversation_repair": Query(op11_conversation_repair, OP11_SQL),
    "op12_collocations": Query(op12_collocations, OP12_SQL),
    "op13_simhash_dedup": Query(op13_simhash_dedup),
}
