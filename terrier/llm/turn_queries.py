"""The query on conversations and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrier.llm import conversation_repair

CONVERSATIONS = "conv_id bigint, turn bigint, role string, text string"


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(CONVERSATIONS).parquet(f"{folder}/conversations.parquet")


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after damage."""
    table = conversations(spark, folder)
    return conversation_repair.repair_report(table, conversation_repair.damage(table))


def _more(value: str, cost: str, edit: str) -> str:
    """SQL: eight digits of cost and the edits so far, with one more edit in front."""
    return f"lpad(CAST(CAST(left({value}, 8) AS INTEGER) + {cost} AS VARCHAR), 8, '0') || '{edit}' || substr({value}, 9)"


#: State after a missing role, and after keeping an initial, for the states 0 to 3.
_WANTED = (2, 2, 3, 2)
_KEPT = (("s", 1, "u", 2), ("u", 2), ("a", 3), ("u", 2))


def _kept(state: int) -> str:
    pairs = zip(_KEPT[state][::2], _KEPT[state][1::2])
    return "CASE " + " ".join(f"WHEN NOT gone AND initial = '{i}' THEN {_more(f's{to}', 'more', 'K')}" for i, to in pairs) + " ELSE '~' END"


def _insertions(inner: str) -> str:
    columns = ", ".join(f"least(s{q}, {_more(f's{to}', '3', 'I')}) AS s{q}" for q, to in enumerate(_WANTED))
    return f"SELECT conv_id, rn, {columns} FROM ({inner})"


_STEP = "SELECT conv_id, rn, " + ", ".join(
    f"least({_more(f's{q}', '4', 'D')}, {_kept(q)}, CASE WHEN NOT gone THEN {_more(f's{to}', '3 + more', 'R')} ELSE '~' END) AS s{q}"
    for q, to in enumerate(_WANTED)) + """
  FROM (SELECT r.conv_id, r.rn, r.gone, r.initial, r.more, w.s0, w.s1, w.s2, w.s3
        FROM best w JOIN marked r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.rn = w.rn - 1)"""

OP11_SQL = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
summed AS (  -- CRC-32: each byte, then eight shifts
  SELECT *, xor(4294967295, list_reduce(
    list_prepend(4294967295, flatten(list_transform(range(1, length(k) + 1), lambda i: list_prepend(
      CAST(ascii(substr(k, CAST(i AS BIGINT), 1)) AS BIGINT), [-1, -1, -1, -1, -1, -1, -1, -1])))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END)) % 20 AS d FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM summed)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS rn,
         rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
         left(role, 1) AS initial FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 AS again FROM placed),
marked AS (
  SELECT *, body = '' AS blank, body <> '' AND again AS duplicate,
         body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS truncated,
         body = '' OR again AS gone, CASE WHEN right(body, 1) IN ('.', '!', '?') THEN 0 ELSE 3 END AS more,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY rn) || initial NOT IN ('su', 'ua', 'au') AS illegal FROM seen),
best AS (
  SELECT conv_id, max(rn) + 1 AS rn, '00000000' AS s0, '00000006II' AS s1, '00000003I' AS s2, '00000000' AS s3
  FROM marked GROUP BY conv_id
  UNION ALL {_insertions(_insertions(_insertions(_STEP)))}),
audits AS (SELECT conv_id, CAST(left(s0, 8) AS BIGINT) AS cost, substr(s0, 9) AS audit FROM best WHERE rn = 1),
edits AS (
  SELECT conv_id, i, substr(audit, CAST(i AS BIGINT), 1) AS e
  FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS i FROM audits)),
counted AS (
  SELECT *, sum(CASE WHEN e <> 'I' THEN 1 ELSE 0 END) OVER w AS rn,
         sum(CASE WHEN e <> 'D' THEN 1 ELSE 0 END) OVER w AS p
  FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
kept AS (
  SELECT c.conv_id, c.e, c.p, m.role, CASE WHEN c.e = 'I' THEN '' ELSE m.text END AS text,
         max(CASE WHEN c.p = 1 AND c.e = 'K' AND m.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY c.conv_id) AS s
  FROM counted c LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM c.conv_id AND m.rn = c.rn
  WHERE c.e <> 'D'),
repaired AS (
  SELECT conv_id, sha256(string_agg(
    CASE WHEN e = 'K' THEN role WHEN (p - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text,
    chr(10) ORDER BY p)) AS h FROM kept GROUP BY conv_id),
faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal
  FROM marked GROUP BY conv_id)
SELECT o.conv_id, CAST(coalesce(f.gaps, 0) AS BIGINT) AS gaps, coalesce(f.blank, 0) AS blank,
       coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated, coalesce(f.illegal, 0) AS illegal,
       coalesce(a.cost, 0) AS cost, coalesce(a.audit, '') AS audit, coalesce(r.h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN audits a ON a.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""
