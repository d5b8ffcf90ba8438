"""Sinks that commit: what a job writes to one table or several is there as a whole or not at all.

Tasks write their lines into hidden folders beside the data and answer with the names of their files. If all of them
succeed the driver writes one record of the job, which is renamed into place: that is the commit. Then it moves the files to
where plain readers see them. If a task fails for good the job is aborted, and its hidden files go. A driver that dies before the
record leaves hidden files only; one that dies after it leaves a record that ``recover`` carries out, as the next
writer does first. Attempts that Spark ran twice are no matter: only the files in the answers that it accepted are named.

One job at a time writes to a table. Paths are those of stores that ``stores`` reaches."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from corpusloom.sources import stores

STAGED, LOG = "_staged-", "_commits"


@dataclass
class Written(WriterCommitMessage):
    """(table, hidden file, lines) of a task."""

    files: list[tuple[str, str, int]]


class CommittedWriter(DataSourceArrowWriter):
    """Writes rows (table, line). Options: path, where the log is kept; job; target.<table>, a folder; head.<table>, a first
    line of every file; ending; replace, to put the lines in the place of what the tables had."""

    def __init__(self, options: dict):
        self.log = options["path"].rstrip("/")
        self.job = options.get("job") or uuid.uuid4().hex
        self.targets = {k.split(".", 1)[1]: v.rstrip("/") for k, v in options.items() if k.startswith("target.")}
        self.heads = {k.split(".", 1)[1]: v for k, v in options.items() if k.startswith("head.")}
        self.ending, self.replace = options.get("ending", ".json"), options.get("replace", "false") == "true"

    def write(self, iterator: Iterator) -> Written:
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}{self.ending}"
        open_files, counts = {}, {}
        for batch in iterator:
            for table, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if table not in open_files:
                    folder = f"{self.targets[table]}/{STAGED}{self.job}"
                    stores.make(folder)
                    store, inner = stores.at(f"{folder}/{name}")
                    open_files[table], counts[table] = store.open_output_stream(inner), 0
                    if table in self.heads:
                        open_files[table].write(self.heads[table].encode() + b"\n")
                open_files[table].write((line or "").encode() + b"\n")
                counts[table] += 1
        for f in open_files.values():
            f.close()
        return Written([(t, f"{self.targets[t]}/{STAGED}{self.job}/{name}", n) for t, n in counts.items()])

    def commit(self, messages: list) -> None:
        moves, rows = [], {t: 0 for t in self.targets}
        for m in messages:
            for table, hidden, n in m.files if m else []:
                moves.append([hidden, f"{self.targets[table]}/{hidden.rsplit('/', 1)[1]}"])
                rows[table] += n
        gone = [f for t in self.targets.values() for f in stores.files_in(t)] if self.replace else []
        staged = [f"{t}/{STAGED}{self.job}" for t in self.targets.values()]
        stores.make(f"{self.log}/{LOG}")
        stores.write(record := f"{self.log}/{LOG}/{self.job}.json", json.dumps({"job": self.job, "rows": rows, "removes": gone, "moves": moves, "staged": staged}).encode())
        _carry_out(record)

    def abort(self, messages: list) -> None:
        for target in self.targets.values():
            stores.remove(f"{target}/{STAGED}{self.job}")


class Committed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "committed"

    def schema(self) -> str:
        return "table string, line string"

    def writer(self, schema, overwrite: bool) -> CommittedWriter:
        return CommittedWriter(dict(self.options))


def _carry_out(record: str) -> None:
    """Does what a record says and may be done again at any point; the record ends as one of a job that is over."""
    job = json.loads(stores.read(record))
    if job.get("over"):
        return
    for _, target in job["moves"]:
        stores.make(target.rsplit("/", 1)[0])
    for old in job["removes"]:
        stores.remove(old)
    for hidden, target in job["moves"]:
        stores.move(hidden, target)
    for folder in job["staged"]:
        stores.remove(folder)
    stores.write(record, json.dumps({"job": job["job"], "rows": job["rows"], "over": True}).encode())


def recover(log: str, *targets: str) -> None:
    """Carries out what was committed and removes what was not, before the next job writes."""
    for record in stores.files_in(f"{log.rstrip('/')}/{LOG}", ".json") if stores.exists(f"{log.rstrip('/')}/{LOG}") else []:
        _carry_out(record)
    for target in targets or (log,):
        for folder in stores.folders_in(target):
            if folder.startswith(STAGED):
                stores.remove(f"{target.rstrip('/')}/{folder}")


def jobs(spark: SparkSession, log: str) -> DataFrame:
    """(job, rows: lines by table) of what was committed."""
    schema = "job string, rows map<string,bigint>"
    path = f"{log.rstrip('/')}/{LOG}"
    return spark.read.schema(schema).json(stores.files_in(path, ".json")) if stores.exists(path) else spark.createDataFrame([], schema)


def commit(tables: dict[str, tuple[DataFrame, Column, str]], log: str, job: str | None = None, heads: dict[str, str] | None = None, ending: str = ".json", replace: bool = False) -> None:
    """Writes tables, {name: (rows, the line of a row, folder)}, in one commit. A job of a name that is committed is over."""
    spark = next(iter(tables.values()))[0].sparkSession
    spark.dataSource.register(Committed)
    recover(log, *[folder for _, _, folder in tables.values()])
    if job is not None and stores.exists(f"{log.rstrip('/')}/{LOG}/{job}.json"):
        return
    lines = None
    for name, (rows, line, _) in tables.items():
        part = rows.select(F.lit(name).alias("table"), line.alias("line"))
        lines = part if lines is None else lines.union(part)
    options = {f"target.{k}": folder for k, (_, _, folder) in tables.items()} | {f"head.{k}": v for k, v in (heads or {}).items()}
    options |= {"path": log, "ending": ending, "replace": str(replace).lower(), "job": job or uuid.uuid4().hex}
    lines.write.format("committed").options(**options).mode("append").save()


def json_line(df: DataFrame) -> Column:
    return F.to_json(F.struct(*df.columns))


def csv_line(*columns: str) -> Column:
    return F.to_csv(F.struct(*columns), {"escape": '"'})
