"""Query and SQL of the filter audit. The SQL counts masks of failures and walks every order; it uses no cube."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import table
from corpusloom.llm.filter_audit import audit


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
firsts AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, (len(ws) < 100)::INT + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::INT
             + 4 * (100 * len(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * len(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
             + 16 * coalesce(d.doc_id > least, false)::INT AS mask, coalesce(good, 0) AS good, coalesce(known.toxic, 0) AS toxic
      FROM d JOIN firsts USING (t) LEFT JOIN known USING (doc_id)),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
l AS (SELECT unnest(range(5)) AS i),
o AS (SELECT [a.i, b.i, c.i, e.i, g.i] AS p FROM l a, l b, l c, l e, l g WHERE len(list_distinct([a.i, b.i, c.i, e.i, g.i])) = 5),
s AS (SELECT array_to_string(list_transform(p, lambda x: substr('ABCDE', x + 1, 1)), '') AS filter_order, step, 1 << p[step] AS bit,
             list_sum(list_transform(p[1 : step - 1], lambda x: 1 << x)) AS sofar
      FROM (SELECT p, unnest(range(1, 6)) AS step FROM o)),
r AS (SELECT part, filter_order, step, bit,
             sum(CASE WHEN mask & (coalesce(sofar, 0) | bit)::INT = 0 THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN mask & coalesce(sofar, 0)::INT = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN mask & coalesce(sofar, 0)::INT <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN mask & coalesce(sofar, 0)::INT = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN mask & coalesce(sofar, 0)::INT = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
      FROM m, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
 CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
 CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""
