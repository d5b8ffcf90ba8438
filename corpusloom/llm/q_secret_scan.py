"""Query and SQL of the secret scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import secret_scan as S
from corpusloom.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In two increments: about half of the documents as an earlier one, whose blobs go to the ledger, then all documents, of
    which only unseen blobs are scanned; old and new findings are joined back to every document."""
    documents = table(spark, sf_dir, "documents")
    earlier = documents.where(F.xxhash64("doc_id") > 0)
    ledger, findings = S.scan_increment(earlier)
    found = S.scan_versions(documents, ledger=ledger, findings=findings)
    base = F.filter("spans", lambda x: x["rank"] < len(S.BASE_RULES))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(S.render(base), 256).alias("base_sha256"),
        S.render(F.col("spans")).alias("spans"),
    )


def _sql_rule(rule: S.Rule, rank: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
    SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind,
           list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i-1], lambda y: length(y))), 0) AS s,
           length(m[i]) AS n
    FROM (SELECT doc_id, m, j, g, unnest(range(1, len(m) + 1)) AS i
          FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {rule.group}) AS j,
                       regexp_split_to_array(t, '{pattern}') AS g
                FROM docs WHERE regexp_matches(t, '{pattern}')))
    WHERE length(j[i]) >= {rule.min_chars}"""


ORACLE = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_sql_rule(r, k) for k, r in enumerate(S.RULES))}),
said AS (SELECT doc_id, rank, kind, CAST(s AS BIGINT) AS s, kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s + n AS BIGINT) AS VARCHAR) AS one FROM found),
folded AS (
  SELECT doc_id,
         count(*) FILTER (WHERE kind = 'assign') AS n_assign,
         count(*) FILTER (WHERE kind = 'access') AS n_access,
         count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         string_agg(one, ',' ORDER BY s, rank) FILTER (WHERE rank < {len(S.BASE_RULES)}) AS base,
         string_agg(one, ',' ORDER BY s, rank) AS spans
  FROM said GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN folded f USING (doc_id)
"""
