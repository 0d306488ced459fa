"""The queries on phrases and SimHashes, and the SQL of the first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrier.llm import collocations, simhash_dedup

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The phrases of each language whose words stick together most."""
    return collocations.collocations(spark.read.schema(DOCUMENTS).parquet(f"{folder}/documents.parquet"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, w, unnest([1, 2, 3, 4]) AS m FROM words),
counts AS (
  SELECT lang, m, phrase, count(*) AS n FROM (
    SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' ')))
      AS phrase FROM sizes) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM counts WHERE m = 1 GROUP BY lang),
often AS (SELECT lang, m, phrase, n AS a, string_split(phrase, ' ') AS w FROM counts WHERE n >= 30),
parts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, m)) AS k FROM often WHERE m > 1)),
cuts AS (
  SELECT p.*, x.a AS l, y.a AS r, (2000000::HUGEINT * p.a) // (x.a::HUGEINT + y.a) AS score
  FROM parts p JOIN often x ON x.lang = p.lang AND x.phrase = p.head JOIN often y ON y.lang = p.lang AND y.phrase = p.tail),
least AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_phrases AS (
  SELECT lang, a, array_to_string(w[i:i + s - 1], ' ') AS phrase FROM (
    SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM often WHERE m > 2))),
around AS (SELECT lang, phrase, max(a) AS most FROM inner_phrases GROUP BY lang, phrase),
alone AS (
  SELECT l.* FROM least l LEFT JOIN around o ON o.lang = l.lang AND o.phrase = l.phrase
  WHERE o.most IS NULL OR 100::HUGEINT * o.most < 80::HUGEINT * l.a),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM alone)
SELECT lang, rank, phrase, a, l, r, t.n AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals t USING (lang) WHERE rank <= 2000
"""


def op13_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The SimHash of every document and the smallest id among its near copies."""
    return simhash_dedup.near_duplicates(spark.read.schema(DOCUMENTS).parquet(f"{folder}/documents.parquet"))
