"""Secret scan over an incremental blob ledger, in DataFrame and SQL functions only.

Every version of every file is content-addressed by the SHA-256 of its text. A ledger holds the
(blob, rule, rule version) triples that were scanned before; only unseen pairs of blob and rule
version are scanned, once per distinct blob. Beside the ledger stands a table of findings by the same key;
old and new findings are joined back to every path that holds the blob, and those of rule versions that
are no longer in use are left out.

Offsets are not available from Spark's regular-expression functions, so they are rebuilt: ``split``
gives the text between matches and ``regexp_extract_all`` the matches themselves, and their lengths
in code points add up to the spans.

Defined results: null and empty texts have no findings and stay in the output; texts of any length are scanned whole;
spans that start together are listed in the order of the rules; repeated rows are kept
one for one; an empty table gives an empty result; only the id and text columns of the input are read,
so other columns of any name cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut


@dataclass(frozen=True)
class Rule:
    """A detector: ``pattern`` finds candidates, leftmost and non-overlapping; a candidate whose capture
    ``group`` has fewer than ``min_chars`` code points is dropped without a retry. ``hint`` is a literal
    that every match holds, tested first as it is much cheaper."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    min_chars: int = 1
    hint: str = ""


#: The contract's base detectors, in the order in which equal starts are listed.
BASE_RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", 0, 16, "AKIA"),
    Rule("hex", 1, r"[0-9a-f]{32,}", 0, 32),
)
#: Detectors added to the base ones. Their spans are only ever additional.
EXTRA_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----", 0, 1, "-----BEGIN "),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 1, "eyJ"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, "gh"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1, "xox"),
)
RULES = BASE_RULES + EXTRA_RULES

LEDGER_SCHEMA = "blob string, kind string, version int"
FINDINGS_SCHEMA = "blob string, kind string, version int, start bigint, end bigint"
#: Elements whose places are summed by one growing array, and blobs that a join may broadcast (64 digits each).
BLOCK, BROADCAST_BLOBS = 128, 500_000
SPANS = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def blob_id(text: Column) -> Column:
    return F.sha2(text, 256)


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """array<struct<start, rank, end, kind>> of one rule's spans, in code points, end exclusive."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    judged = F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    rows = F.arrays_zip(
        F.transform(found, lambda x: F.length(x).cast("long")).alias("n"),
        F.transform(judged, lambda x: F.length(x) >= rule.min_chars).alias("ok"),
        F.transform(F.slice(gaps, F.lit(1), F.size(found)), lambda x: F.length(x).cast("long")).alias("gap"),
    )
    spans = _bound(rows, lambda x: _bound(_blocks(x), lambda blocks: _placed(blocks, rule.kind, rank)))
    hit = text.rlike(rule.pattern)
    if rule.hint:
        hit = text.contains(rule.hint) & hit
    return F.when(hit, spans).otherwise(F.array().cast(SPANS))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once: as the element of an array of one."""
    return F.transform(F.array(value), use)[0]


def _blocks(x: Column) -> Column:
    """An array in pieces of BLOCK elements."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda k: F.slice(x, k * BLOCK + 1, BLOCK))


def _placed(blocks: Column, kind: str, rank: int) -> Column:
    """The spans of blocks of (n, ok, gap). Arrays grow by copies, so positions are summed in two levels: where each block
    begins, and from there on within the block."""
    begun = F.aggregate(
        blocks,
        F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<bigint>").alias("out")),
        lambda acc, block: F.struct(
            F.aggregate(block, acc["pos"], lambda p, x: p + x["gap"] + x["n"]).alias("pos"), F.concat(acc["out"], F.array(acc["pos"])).alias("out")
        ),
        lambda acc: acc["out"],
    )

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["gap"]
        end = start + x["n"]
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind")))
        return F.struct(end.alias("pos"), F.when(x["ok"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def inside(z: Column) -> Column:
        zero = F.struct(z["at"].alias("pos"), F.array().cast(SPANS).alias("out"))
        return F.aggregate(z["block"], zero, step, lambda acc: acc["out"])

    return F.flatten(F.transform(F.arrays_zip(blocks.alias("block"), begun.alias("at")), inside))


def unseen_blobs(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text, todo): one row per distinct blob that some rule version has not scanned yet.

    ``versions`` needs ``blob`` and ``text``. Copies of a blob meet in a map-side combined aggregation,
    so a blob that holds a third of all rows costs one row per map task."""
    all_pairs = F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules])
    grouped = lambda rows: rows.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        return grouped(versions).withColumn("todo", all_pairs)
    seen = cut(
        ledger.select("blob", F.concat_ws("@", "kind", F.col("version").cast("string")).alias("pair"))
        .where(F.col("pair").isin(*[f"{r.kind}@{r.version}" for r in rules]))
        .groupBy("blob")
        .agg(F.collect_set("pair").alias("seen"))
    )
    done, some = (seen.where(F.size("seen") == len(rules)).select("blob"), seen.where(F.size("seen") < len(rules)))
    todo = F.array_except(all_pairs, F.coalesce("seen", F.array().cast("array<string>")))
    return grouped(_without(versions, done)).join(some, "blob", "left").select("blob", "text", todo.alias("todo"))


def _without(versions: DataFrame, done: DataFrame) -> DataFrame:
    """The versions of blobs that are not ``done``. Their texts stay where they are read, whichever of the done blobs and of
    those left is small enough to be sent to them; where neither is, copies meet before the join."""
    small = lambda rows: rows.limit(BROADCAST_BLOBS + 1).count() <= BROADCAST_BLOBS
    if small(done):
        return versions.join(F.broadcast(done), "blob", "left_anti")
    left = cut(versions.select("blob").distinct().join(done, "blob", "left_anti"))
    if small(left):
        return versions.join(F.broadcast(left), "blob", "left_semi")
    return versions.groupBy("blob").agg(F.first("text").alias("text")).join(left, "blob", "left_semi")


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, todo, spans): the spans of the unseen rules of each blob, by start, then rule order."""
    parts = [
        F.when(F.array_contains("todo", f"{r.kind}@{r.version}"), _spans(F.col("text"), r, k)) for k, r in enumerate(rules)
    ]
    parts = [F.coalesce(p, F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")) for p in parts]
    return blobs.select("blob", "todo", F.array_sort(F.concat(*parts)).alias("spans"))


def ledger_rows(scanned: DataFrame) -> DataFrame:
    """What to append to the ledger after a scan: (blob, kind, version)."""
    pair = F.split("pair", "@")
    return scanned.select("blob", F.explode("todo").alias("pair")).select(
        "blob", pair[0].alias("kind"), pair[1].cast("int").alias("version")
    )


def finding_rows(scanned: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What to append to the findings after a scan by ``rules``: (blob, kind, version, start, end)."""
    version = F.element_at(F.create_map(*[F.lit(x) for r in rules for x in (r.kind, r.version)]), F.col("s.kind"))
    return scanned.select("blob", F.explode("spans").alias("s")).select("blob", "s.kind", version.alias("version"), "s.start", "s.end")


def _known(findings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, spans): the findings of the versions of ``rules``."""
    rank = F.coalesce(*[F.when((F.col("kind") == r.kind) & (F.col("version") == r.version), F.lit(k)) for k, r in enumerate(rules)])
    return (
        findings.select("blob", "start", rank.alias("rank"), "end", "kind")
        .where("rank IS NOT NULL")
        .groupBy("blob")
        .agg(F.collect_set(F.struct("start", "rank", "end", "kind")).cast(SPANS).alias("spans"))
    )


def scan_versions(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ledger: DataFrame | None = None,
    rules: tuple[Rule, ...] = RULES,
    findings: DataFrame | None = None,
) -> DataFrame:
    """(id_col, blob, spans): the findings of every path, an empty array where there are none.

    Blobs whose rule versions are all in ``ledger`` are not scanned again; what was found in them then is taken
    from ``findings``. A ledger without its findings gives the new ones only."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    versions = df.select(F.col(id_col), blob_id(text).alias("blob"), text.alias("text"))
    # The few findings are written once; a table of its own, they can be dealt anew beside a blob that many paths hold.
    found = cut(scan_blobs(unseen_blobs(versions, ledger, rules), rules).where(F.size("spans") > 0).select("blob", "spans"))
    if findings is not None:
        both = found.union(_known(findings, rules)).groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
        found = cut(both.join(versions.select("blob").distinct(), "blob", "left_semi").select("blob", _bound(F.array_sort("spans"), _single).alias("spans")))
    none = F.array().cast(SPANS)
    return (
        versions.select(id_col, "blob")
        .join(found, "blob", "left")
        .select(id_col, "blob", F.coalesce("spans", none).alias("spans"))
    )


def scan_increment(
    df: DataFrame, text_col: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES
) -> tuple[DataFrame, DataFrame]:
    """(ledger rows, findings) of what ``ledger`` has not seen of ``df``, scanned once: to be appended to both."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    versions = df.select(blob_id(text).alias("blob"), text.alias("text"))
    scanned = cut(scan_blobs(unseen_blobs(versions, ledger, rules), rules))
    return ledger_rows(scanned), finding_rows(scanned, rules)


def _single(spans: Column) -> Column:
    """A sorted array without repeats, each compared with the one before it."""
    return F.filter(spans, lambda x, i: (i == 0) | (x != F.get(spans, i - 1)))


def render(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")
