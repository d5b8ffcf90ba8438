"""Query and SQL of the personal-data search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import pii as P
from corpusloom.llm.common import table


def _render(spans):
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def op4_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.find_pii(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"].isin(*P.BASE_KINDS))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in P.BASE_KINDS],
        F.sha2(_render(base), 256).alias("base_sha256"),
        _render(F.col("spans")).alias("spans"),
    )


_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_LUHN = (
    f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda p: CASE WHEN (length({_DIGITS}) - p) % 2 = 0 "
    f"THEN CAST(substr({_DIGITS}, p, 1) AS INT) ELSE 2 * CAST(substr({_DIGITS}, p, 1) AS INT) "
    f"- CASE WHEN CAST(substr({_DIGITS}, p, 1) AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
)
#: kind: (pattern, test of the match x)
_RULES = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(right(p, 3) AS INT), 0) > 255)) = 0",
    ),
    "card": (r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
    "url": (rf"({'|'.join(sorted(P.SCHEMES, key=len, reverse=True))}){P.USERINFO.pattern}", "true"),
    "account": (P.ACCOUNT.pattern, "true"),
    "ssn": (P.SSN.pattern, "true"),
}


def _sql_rule(rank: int, kind: str, pattern: str, test: str) -> str:
    return f"""
    SELECT * FROM (
    SELECT doc_id, {rank} AS rank, '{kind}' AS kind, m[i] AS x,
           list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i-1], lambda y: length(y))), 0) AS s
    FROM (SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i
          FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS g
                FROM docs WHERE regexp_matches(t, '{pattern}')))) WHERE {test}"""


ORACLE = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_sql_rule(k, n, *r) for k, (n, r) in enumerate(_RULES.items()))}),
said AS (SELECT doc_id, rank, kind, CAST(s AS BIGINT) AS s, kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(s + length(x) AS BIGINT) AS VARCHAR) AS one FROM found),
folded AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in P.BASE_KINDS)},
         string_agg(one, ',' ORDER BY s, rank) FILTER (WHERE rank < 4) AS base,
         string_agg(one, ',' ORDER BY s, rank) AS spans
  FROM said GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in P.BASE_KINDS)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN folded f USING (doc_id)
"""
