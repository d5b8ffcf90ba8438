"""Query and SQL of the benchmark decontamination. The SQL compares every window exactly, without fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table
from corpusloom.llm.decontaminate import contaminated


def op7_benchmark_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), F.col("start").cast("long").alias("start"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS ws FROM benchmark),
ds AS (SELECT doc_id, len(ws) AS total, p, array_to_string(ws[p + 1 : p + 5], ' ') AS s FROM (SELECT *, unnest(range(0, len(ws) - 4)) AS p FROM d WHERE len(ws) >= 5)),
bs AS (SELECT item_id, len(ws) AS m, q, array_to_string(ws[q + 1 : q + 5], ' ') AS s FROM (SELECT *, unnest(range(0, len(ws) - 4)) AS q FROM b WHERE len(ws) >= 5)),
near AS (SELECT DISTINCT doc_id, item_id, m, total, p - q AS dia FROM ds JOIN bs USING (s)),
starts AS (SELECT DISTINCT doc_id, item_id, m, greatest(0, least(dia + j, total - m)) AS st
           FROM (SELECT *, unnest(range(-((m - 4) // 9), (m - 4) // 9 + 1)) AS j FROM near)),
w AS (SELECT st.doc_id, st.item_id, st.st, st.m, ds.s, count(*) AS n FROM starts st JOIN ds ON ds.doc_id = st.doc_id AND ds.p >= st.st AND ds.p <= st.st + st.m - 5 GROUP BY ALL),
i AS (SELECT item_id, s, count(*) AS n FROM bs GROUP BY ALL),
sizes AS (SELECT doc_id, item_id, st, m, sum(n) AS size FROM w GROUP BY ALL),
common AS (SELECT w.doc_id, w.item_id, w.st, sum(least(w.n, i.n)) AS c FROM w JOIN i ON i.item_id = w.item_id AND i.s = w.s GROUP BY ALL),
sims AS (SELECT doc_id, item_id, st, CAST(c AS DOUBLE) / CAST(size + m - 4 - c AS DOUBLE) AS sim FROM sizes JOIN common USING (doc_id, item_id, st)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY sim DESC, st) AS rn FROM sims WHERE sim >= 0.8)
SELECT doc_id, item_id, round(sim, 6) AS similarity, CAST(st AS BIGINT) AS start FROM best WHERE rn = 1
"""
