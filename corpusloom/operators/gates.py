"""Gates before an evaluation set is used: names and texts of trained screens, equal contents, personal data."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.leakage import GateError, collisions, denied
from corpusloom.operators.validate import mail_fields


def problems(
    rows: DataFrame, denylist: list[str], id_col: str = "id", path: str = "image", substrate: str = "planted_from", content: str = "content",
    known: DataFrame | None = None, known_content: str = "content", known_path: str = "path", text_fields: list[str] | None = None,
) -> DataFrame:
    """(id, rule, detail): rows named like a screen of the denylist, or made from one; rows whose content equals that of
    a known row, whose path is the detail; and text fields with personal data. Without ``known`` rows the contents are
    not compared, which a warning says: the other rules still hold."""
    found = denied(rows, denylist, F.col(path), F.col(substrate))
    say = lambda df, rule, detail: df.select(F.col(id_col).alias("id"), F.lit(rule).alias("rule"), detail.alias("detail"))
    parts = [say(found.where("by_name"), "name", F.col(path)), say(found.where("by_substrate"), "substrate", F.col(substrate))]
    if known is None:
        warnings.warn("no known contents: content hashes are not compared, the denylist still is", stacklevel=2)
    else:
        parts.append(say(collisions(rows, known, content, known_content, known_path), "content", F.col("matched")))
    if text_fields:
        parts.append(mail_fields(rows, id_col, text_fields).select(F.col(id_col).alias("id"), F.lit("personal").alias("rule"), F.col("field").alias("detail")))
    return reduce(DataFrame.unionByName, parts)


def enforce(found: DataFrame, most: int = 20) -> None:
    """Fails closed: GateError that names the first problems, if there is any."""
    rows = found.orderBy("id", "rule").limit(most).collect()
    if rows:
        raise GateError("; ".join(f"{r['id']}: {r['rule']} {r['detail']}" for r in rows))


def admitted(rows: DataFrame, known: DataFrame, content: str = "content", known_content: str = "content", known_path: str = "path") -> DataFrame:
    """The rows, once none of them has the content of a known one; else GateError that names the paths."""
    hit = collisions(rows, known, content, known_content, known_path).select("matched").limit(20).collect()
    if hit:
        raise GateError(f"contents that are known: {[r['matched'] for r in hit]}")
    return rows
