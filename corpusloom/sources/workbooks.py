"""Sheets of workbooks: a workbook is a zip of XML members, and a task streams the members that its sheet needs.

Rows are read one at a time and strings that cells share as far as they are asked for, so a task holds a file's shared strings at
most. Cells are strings as they are stored: whole numbers without a point, dates as day numbers, TRUE and FALSE, formulas as the
value that was saved. Empty cells are null, as in CSV, and rows of empty cells are left out."""

from __future__ import annotations

import io
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

from corpusloom.sources import stores

ENDING = ".xlsx"
#: Fixed values of the format: its namespaces, and what a sheet and a cell may hold.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
MOST_ROWS, MOST_CHARS = 1_048_576, 32_767
#: Rows of a batch that a task hands to Spark.
BATCH = 2_000
_ESCAPED = re.compile("_x([0-9A-Fa-f]{4})_")
_CONTROL = re.compile("[\x00-\x08\x0b-\x1f\ufffe\uffff]|_(?=x[0-9A-Fa-f]{4}_)")


class BadWorkbook(ValueError):
    """A file that is no workbook, or has no such sheet; the message names it."""


def _tag(name: str) -> str:
    return f"{{{MAIN}}}{name}"


def _elements(member, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a tag, one after the other; those that have been read are let go."""
    above: list[ElementTree.Element] = []
    for event, e in ElementTree.iterparse(member, events=("start", "end")):
        if event == "start":
            above.append(e)
            continue
        above.pop()
        if e.tag == tag:
            yield e
            above[-1].remove(e)


def _text(e: ElementTree.Element | None) -> str:
    """The text of a plain or rich string, without its phonetic readings."""
    if e is None:
        return ""
    found = e.findall(_tag("t")) + e.findall(f"{_tag('r')}/{_tag('t')}")
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), "".join(t.text or "" for t in found))


class Shared:
    """The strings that cells share, read as far as they are asked for."""

    def __init__(self, book: zipfile.ZipFile):
        there = "xl/sharedStrings.xml" in book.namelist()
        self.rest = (_text(e) for e in _elements(book.open("xl/sharedStrings.xml"), _tag("si"))) if there else iter(())
        self.known: list[str] = []

    def __getitem__(self, k: int) -> str:
        while len(self.known) <= k:
            text = next(self.rest, None)
            if text is None:
                raise IndexError(f"shared string {k} of {len(self.known)}")
            self.known.append(text)
        return self.known[k]


@contextmanager
def _opened(path: str):
    store, inner = stores.at(path)
    with store.open_input_file(inner) as f:
        try:
            with zipfile.ZipFile(f) as book:
                yield book
        except BadWorkbook:
            raise
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, IndexError, ValueError) as e:
            raise BadWorkbook(f"{path}: {e!r}") from None


def sheets(book: zipfile.ZipFile) -> dict[str, str]:
    """The members of the sheets by name, in their order."""
    with book.open("xl/_rels/workbook.xml.rels") as f:
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.parse(f).getroot()}
    with book.open("xl/workbook.xml") as f:
        named = [(s.get("name"), targets[s.get(f"{{{RELATIONS}}}id")]) for s in ElementTree.parse(f).getroot().iter(_tag("sheet"))]
    return {name: posixpath.normpath(posixpath.join("/xl", target)).lstrip("/") for name, target in named}


def _column(reference: str) -> int:
    at = 0
    for c in reference:
        if not c.isalpha():
            break
        at = 26 * at + ord(c.upper()) - 64
    return at - 1


def _value(cell: ElementTree.Element, shared: Shared) -> str | None:
    kind, stored = cell.get("t", "n"), cell.findtext(_tag("v"))
    if kind == "inlineStr":
        return _text(cell.find(_tag("is"))) or None
    if not stored:
        return None
    if kind == "s":
        return shared[int(stored)] or None
    return {"0": "FALSE", "1": "TRUE"}[stored] if kind == "b" else stored


def rows(book: zipfile.ZipFile, member: str) -> Iterator[dict[int, str]]:
    """The cells of each row by column, from 0; empty ones are left out."""
    shared = Shared(book)
    with book.open(member) as f:
        for row in _elements(f, _tag("row")):
            cells, at = {}, -1
            for c in row.iterfind(_tag("c")):
                at = _column(c.get("r")) if c.get("r") else at + 1
                value = _value(c, shared)
                if value is not None:
                    cells[at] = value
            if cells:
                yield cells


def _header(cells: dict[int, str]) -> list[str]:
    """Names of the columns; a name that is missing or comes again has its number, as in CSV."""
    names = [cells.get(k, "") for k in range(max(cells, default=-1) + 1)]
    low = [n.lower() for n in names]
    return [f"_c{k}" if not n else f"{n}{k}" if low.count(n.lower()) > 1 else n for k, n in enumerate(names)]


def _sheet(book: zipfile.ZipFile, sheet: str | None, path: str) -> str:
    named = sheets(book)
    if not named or (sheet is not None and sheet not in named):
        raise BadWorkbook(f"{path}: no sheet {sheet!r} among {list(named)}")
    return named[sheet] if sheet is not None else next(iter(named.values()))


@dataclass
class SheetPartition(InputPartition):
    path: str
    sheet: str | None

    def __init__(self, path: str, sheet: str | None):
        super().__init__(path)
        self.path, self.sheet = path, sheet


class SheetReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.sheet, self.names = options["path"], options.get("sheet"), schema.names

    def partitions(self) -> list[SheetPartition]:
        files = stores.files_in(self.path, ENDING)
        if self.sheet != "*":
            return [SheetPartition(f, self.sheet) for f in files]
        with ThreadPoolExecutor(16) as pool:
            return [SheetPartition(f, name) for f, names in zip(files, pool.map(_names, files)) for name in names]

    def read(self, partition: SheetPartition) -> Iterator[pa.RecordBatch]:
        with _opened(partition.path) as book:
            found = rows(book, _sheet(book, partition.sheet, partition.path))
            at = {name: k for k, name in enumerate(_header(next(found, {})))}
            batch: list[dict[int, str]] = []

            def columns() -> pa.RecordBatch:
                made = [
                    pa.array([partition.sheet] * len(batch) if self.sheet == "*" and k == 0 else [r.get(at.get(n, -1)) for r in batch], pa.string())
                    for k, n in enumerate(self.names)
                ]
                return pa.RecordBatch.from_arrays(made, names=self.names)

            for row in found:
                batch.append(row)
                if len(batch) == BATCH:
                    yield columns()
                    batch.clear()
            if batch:
                yield columns()


def _names(path: str) -> list[str]:
    with _opened(path) as book:
        return list(sheets(book))


@dataclass
class BooksWritten(WriterCommitMessage):
    files: list[str]


class BookWriter(DataSourceArrowWriter):
    """Writes workbooks of one sheet and ``bookrows`` rows at most, hidden until the job commits."""

    def __init__(self, options: dict, names: list[str]):
        self.path, self.sheet, self.names = options["path"].rstrip("/"), options.get("sheet", "rows"), names
        self.most = min(int(options.get("bookrows", 20_000)), MOST_ROWS - 1)
        self.staged = f"{self.path}/_staged-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> BooksWritten:
        part, files, held = TaskContext.get().partitionId(), [], []

        def flush() -> None:
            files.append(f"part-{part:05d}-{uuid.uuid4().hex}{ENDING}")
            stores.make(self.staged)
            stores.write(f"{self.staged}/{files[-1]}", workbook(self.sheet, [self.names, *held]))
            held.clear()

        for batch in iterator:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                if len(held) == self.most:
                    flush()
        if held:
            flush()
        return BooksWritten(files)

    def commit(self, messages: list) -> None:
        stores.make(self.path)
        for m in messages:
            for name in m.files if m else []:
                stores.move(f"{self.staged}/{name}", f"{self.path}/{name}")
        stores.remove(self.staged)

    def abort(self, messages: list) -> None:
        stores.remove(self.staged)


def workbook(sheet: str, table: list) -> bytes:
    """A workbook of one sheet of strings; null and empty ones have no cell. A longer text than a cell may hold is an error."""
    shared: dict[str, int] = {}

    def cell(value: str | None) -> str:
        if not value:
            return "<c/>"
        if len(value) > MOST_CHARS:
            raise ValueError(f"a cell holds {MOST_CHARS} characters, not {len(value)}")
        return f'<c t="s"><v>{shared.setdefault(value, len(shared))}</v></c>'

    lines = "".join("<row>" + "".join(cell(v) for v in row) + "</row>" for row in table)
    strings = "".join(f'<si><t xml:space="preserve">{escape(_CONTROL.sub(lambda m: f"_x{ord(m[0]):04X}_", s))}</t></si>' for s in shared)
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {"workbook.xml": "sheet.main", "worksheets/sheet1.xml": "worksheet", "sharedStrings.xml": "sharedStrings"}
    overrides = "".join(f'<Override PartName="/xl/{p}" ContentType="{kinds}.{k}+xml"/>' for p, k in parts.items())
    relations = lambda *of: f'<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="r{k}" Type="{RELATIONS}/{kind}" Target="{t}"/>' for k, (kind, t) in enumerate(of)) + "</Relationships>"
    members = {
        "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{overrides}</Types>',
        "_rels/.rels": relations(("officeDocument", "xl/workbook.xml")),
        "xl/_rels/workbook.xml.rels": relations(("worksheet", "worksheets/sheet1.xml"), ("sharedStrings", "sharedStrings.xml")),
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{RELATIONS}"><sheets><sheet name="{escape(sheet, {chr(34): "&quot;"})}" sheetId="1" r:id="r0"/></sheets></workbook>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{MAIN}"><sheetData>{lines}</sheetData></worksheet>',
        "xl/sharedStrings.xml": f'<sst xmlns="{MAIN}">{strings}</sst>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in members.items():
            book.writestr(name, text.encode())
    return out.getvalue()


class Workbooks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def schema(self) -> StructType:
        """The names in the first row of the first file's sheet."""
        path, sheet = self.options["path"], self.options.get("sheet")
        files = stores.files_in(path, ENDING)
        if not files:
            raise FileNotFoundError(path)
        with _opened(files[0]) as book:
            names = _header(next(rows(book, _sheet(book, None if sheet == "*" else sheet, files[0])), {}))
        return StructType([StructField(n, StringType()) for n in (["sheet", *names] if sheet == "*" else names)])

    def reader(self, schema: StructType) -> SheetReader:
        return SheetReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> BookWriter:
        return BookWriter(dict(self.options), schema.names)


def sheet_rows(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Rows of strings of a workbook or of a folder of them, under the names of the first row: of the sheet of that name, of the
    first sheet (none named), or of all sheets, a partition each, the sheet's name first ("*"). Columns of further files and
    sheets are matched by name."""
    spark.dataSource.register(Workbooks)
    reader = spark.read.format("workbooks")
    return (reader if sheet is None else reader.option("sheet", sheet)).load(path)


def write(df: DataFrame, path: str, sheet: str = "rows", book_rows: int = 20_000) -> None:
    """Adds the rows to a folder as workbooks, all of them or none."""
    df.sparkSession.dataSource.register(Workbooks)
    strings = df.selectExpr(*[f"cast(`{c.replace('`', '``')}` AS string) AS `{c.replace('`', '``')}`" for c in df.columns])
    strings.write.format("workbooks").option("path", path).option("sheet", sheet).option("bookrows", str(book_rows)).mode("append").save()
