"""Query and SQL of the dataset manifest. The SQL builds each level of each tree as a list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import table
from corpusloom.llm.merkle_manifest import manifest, verified


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return verified(manifest(table(spark, sf_dir, "documents"), tampered=even))


_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = lambda text: "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
#: One level up: the runs of three of a list h.
_RUNS = "list_transform(range(0, len(h), 3), lambda k: sha256(array_to_string(h[k + 1 : k + 3], '')))"
#: Unsigned CRC-32 of a decimal number, byte by byte.
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1))))"""

ORACLE = rf"""
WITH RECURSIVE d AS (SELECT *, {_LEAF('text')} AS leaf, {_LEAF("replace(text, chr(10), '')")} AS other,
    xor({_CRC}, 4294967295::BIGINT) % 2 = 0 AS even, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, {_LEAF('text')}) - 1 AS pos FROM documents),
s AS (SELECT coalesce('=' || source, '-') AS tree, 0 AS level, list(leaf ORDER BY pos) AS h FROM d GROUP BY source),
t AS (SELECT * FROM s UNION ALL SELECT tree, level + 1, {_RUNS} FROM t WHERE len(h) > 1),
tops AS (SELECT tree, h[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM t WHERE len(h) = 1),
r AS (SELECT 0 AS level, list(subroot ORDER BY pos) AS h FROM tops UNION ALL SELECT level + 1, {_RUNS} FROM r WHERE len(h) > 1),
root AS (SELECT h[1] AS root FROM r WHERE len(h) = 1),
runs AS (SELECT tree, level, i, h[3 * i + 1 : 3 * i + 3] AS f FROM (SELECT *, unnest(range(0, (len(h) + 2) // 3)) AS i FROM t WHERE len(h) > 1)),
over AS (SELECT level, i, h[3 * i + 1 : 3 * i + 3] AS f FROM (SELECT *, unnest(range(0, (len(h) + 2) // 3)) AS i FROM r WHERE len(h) > 1)),
ids AS (SELECT row_number() OVER () AS k, doc_id, leaf, CASE WHEN even THEN coalesce(other, leaf) ELSE leaf END AS start, coalesce('=' || source, '-') AS tree, pos FROM d),
climb AS (
  SELECT k, tree, level, i, f, pos // (3 ** level)::BIGINT % 3 + 1 AS place FROM ids JOIN runs USING (tree) WHERE i = pos // (3 ** (level + 1))::BIGINT
  UNION ALL
  SELECT k, ids.tree, 1000 + level, i, f, tops.pos // (3 ** level)::BIGINT % 3 + 1 FROM ids JOIN tops USING (tree) JOIN over ON i = tops.pos // (3 ** (level + 1))::BIGINT),
path AS (SELECT k, list(struct_pack(f := f, place := place) ORDER BY level) AS way FROM climb GROUP BY k),
fold AS (SELECT k, 1 AS n, start AS x, coalesce(way, []) AS way FROM ids LEFT JOIN path USING (k)
  UNION ALL SELECT k, n + 1, sha256(array_to_string(list_concat(list_concat(way[n].f[1 : way[n].place - 1], [x]), way[n].f[way[n].place + 1 :]), '')), way FROM fold WHERE n <= len(way)),
proof AS (SELECT k, x AS folded_root, sha256(array_to_string(flatten(list_transform(way, lambda w: list_concat(w.f[1 : w.place - 1], w.f[w.place + 1 :]))), '')) AS proof_sha256 FROM fold WHERE n = len(way) + 1)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM ids JOIN proof USING (k) JOIN tops USING (tree), root
"""
