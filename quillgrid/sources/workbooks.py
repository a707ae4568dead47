"""Workbooks (xlsx) as a data source: a task for each sheet, read in pieces; and a sink that writes one for each task.

    spark.dataSource.register(WorkbookSource)
    spark.read.format("quillgrid_workbook").option("path", folder).load()

All cells are strings, as in a sheet that was typed in by hand; empty ones are
null. With ``header`` (the default) the first row of the first sheet has the
names, and columns are found by name in every sheet; else names are given by
``columns`` (comma-separated) or are c1, c2 ... Files and sheets without rows are passed over.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from quillgrid.sources import paths

FORMAT = "quillgrid_workbook"
#: Rows that a sheet may have (a fixed value of the format).
SHEET_ROWS = 1_048_576
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_BAD = re.compile(r"[\x00-\x08\x0b-\x1f￾￿]|_x[0-9A-Fa-f]{4}_")
_CODED = re.compile(r"_x([0-9A-Fa-f]{4})_")


def _open(uri: str) -> zipfile.ZipFile:
    """The file's archive; members are read as they are asked for."""
    system, path = paths.opened(uri)
    return zipfile.ZipFile(system.open_input_file(path))


def sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, member) of the sheets in their order."""
    rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = rels[s.get(_REL)]
        out.append((s.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


def _text(e: ElementTree.Element) -> str:
    """The text of a cell or shared string without its phonetic runs, control characters decoded."""
    parts = [p.text or "" if p.tag == f"{_MAIN}t" else "".join(t.text or "" for t in p.iter(f"{_MAIN}t")) for p in e if p.tag in (f"{_MAIN}t", f"{_MAIN}r")]
    return _CODED.sub(lambda m: chr(int(m[1], 16)), "".join(parts))


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, e in ElementTree.iterparse(f):
            if e.tag == f"{_MAIN}si":
                out.append(_text(e))
                e.clear()
    return out


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def rows(book: zipfile.ZipFile, member: str) -> Iterator[list[str | None]]:
    """The rows of a sheet, one held at a time (besides the book's shared strings)."""
    shared: list[str] | None = None
    with book.open(member) as f:
        whole = None
        for event, e in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                whole = e if e.tag == f"{_MAIN}sheetData" else whole
                continue
            if e.tag != f"{_MAIN}row":
                continue
            row: list[str | None] = []
            for c in e.iter(f"{_MAIN}c"):
                at = _column(c.get("r")) if c.get("r") else len(row)
                row.extend([None] * (at - len(row)))
                kind, value = c.get("t"), c.find(f"{_MAIN}v")
                if kind == "inlineStr":
                    inline = c.find(f"{_MAIN}is")
                    found = _text(inline) if inline is not None else None
                elif value is None or value.text is None:
                    found = None
                elif kind == "s":
                    shared = _shared(book) if shared is None else shared
                    found = shared[int(value.text)]
                elif kind == "b":
                    found = "TRUE" if value.text == "1" else "FALSE"
                else:
                    found = _CODED.sub(lambda m: chr(int(m[1], 16)), value.text)
                row.append(found or None)
            yield row
            if whole is not None:
                whole.clear()


@dataclass
class Sheet(InputPartition):
    file: str
    member: str


def _books(path: str) -> list[str]:
    """The workbooks of a folder (or the one of a path), without lock files, sorted."""
    system, inner = paths.opened(path)
    if system.get_file_info(inner).type == fs.FileType.File:
        return [path]
    return [f"{path.rstrip('/')}/{n}" for n in paths.names(path) if n.lower().endswith(".xlsx") and not n.startswith("~$")]


class WorkbookReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.names = [f.name for f in schema]
        self.path, self.header = options["path"], options.get("header", "true").lower() == "true"

    def partitions(self) -> list[Sheet]:
        out = []
        for file in _books(self.path):
            with _open(file) as book:
                out += [Sheet(file, member) for _, member in sheets(book)]
        return out

    def read(self, partition: Sheet) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.string()) for n in self.names])
        with _open(partition.file) as book:
            each = rows(book, partition.member)
            places = list(range(len(self.names)))
            if self.header:
                own = {n: i for i, n in reversed(list(enumerate(next(each, []))))}
                places = [own.get(n) for n in self.names]
            held: list[list[str | None]] = []

            def batch():
                made = pa.RecordBatch.from_arrays([pa.array([r[p] if p is not None and p < len(r) else None for r in held], pa.string()) for p in places], schema=schema)
                held.clear()
                return made

            size = 0
            for row in each:
                held.append(row)
                size += sum(len(x) for x in row if x)
                if len(held) >= 4096 or size > 1 << 24:
                    yield batch()
                    size = 0
            if held:
                yield batch()


_PARTS = {
    "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{sheets}</Types>',
    "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
}


@dataclass
class Book(WriterCommitMessage):
    file: str | None


class WorkbookWriter(DataSourceArrowWriter):
    """A workbook for each task, in sheets of ``sheet_rows`` rows at most; it counts once the job has committed it (until then its name begins with a dot)."""

    def __init__(self, schema: T.StructType, options: dict):
        self.names = [f.name for f in schema]
        self.folder, self.header = options["path"].rstrip("/"), options.get("header", "true").lower() == "true"
        self.sheet_rows = min(int(options.get("sheet_rows", SHEET_ROWS)), SHEET_ROWS)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Book:
        name, n, book, sheet = f"{uuid.uuid4().hex}.xlsx", 0, None, None
        count = 0
        out = None
        for batch in iterator:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if book is None:
                    system, path = paths.opened(f"{self.folder}/.{name}")
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(path)
                    book = zipfile.ZipFile(io.BufferedWriter(_Raw(out)), "w", zipfile.ZIP_DEFLATED)
                if sheet is None or n >= self.sheet_rows:
                    if sheet:
                        self._end(sheet)
                    count, n = count + 1, 0
                    sheet = book.open(f"xl/worksheets/sheet{count}.xml", "w", force_zip64=True)
                    sheet.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_MAIN[1:-1]}"><sheetData>'.encode())
                    if self.header:
                        n += 1
                        self._row(sheet, n, self.names)
                n += 1
                self._row(sheet, n, row)
        if book is None:
            return Book(None)
        self._end(sheet)
        numbers = range(1, count + 1)
        book.writestr("[Content_Types].xml", _PARTS["[Content_Types].xml"].replace("{sheets}", "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in numbers)))
        book.writestr("_rels/.rels", _PARTS["_rels/.rels"])
        book.writestr("xl/_rels/workbook.xml.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{k}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in numbers) + "</Relationships>")
        book.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{_MAIN[1:-1]}" xmlns:r="{_REL[1:].split("}")[0]}"><sheets>' + "".join(f'<sheet name="Sheet{k}" sheetId="{k}" r:id="rId{k}"/>' for k in numbers) + "</sheets></workbook>")
        book.close()
        out.close()
        return Book(name)

    def _row(self, sheet, number: int, row) -> None:
        cells = []
        for i, x in enumerate(row):
            if x is not None and x != "":
                column, k = "", i + 1
                while k:
                    k, r = divmod(k - 1, 26)
                    column = chr(65 + r) + column
                safe = escape(_BAD.sub(lambda m: f"_x{ord(m[0]):04X}_" if len(m[0]) == 1 else f"_x005F_{m[0][1:]}", str(x)))
                cells.append(f'<c r="{column}{number}" t="inlineStr"><is><t xml:space="preserve">{safe}</t></is></c>')
        sheet.write((f'<row r="{number}">' + "".join(cells) + "</row>").encode("utf-8", "surrogatepass"))

    @staticmethod
    def _end(sheet) -> None:
        sheet.write(b"</sheetData></worksheet>")
        sheet.close()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            if m and m.file:
                system, path = paths.opened(f"{self.folder}/.{m.file}")
                system.move(path, path.replace(f"/.{m.file}", f"/{m.file}"))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            if m and m.file:
                paths.remove(f"{self.folder}/.{m.file}")


class _Raw(io.RawIOBase):
    """A pyarrow output stream that can only be appended to, as Python's zip writer wants it."""

    def __init__(self, out):
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(bytes(data))
        return len(data)


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        """Names from the header of the first sheet that has rows, or positional ones as wide as its first row."""
        header = self.options.get("header", "true").lower() == "true"
        if self.options.get("columns"):
            return _strings(self.options["columns"].split(","))
        for file in _books(self.options["path"]):
            with _open(file) as book:
                for _, member in sheets(book):
                    if first := next(rows(book, member), None):
                        return _strings([x for x in first if x] if header else [f"c{k + 1}" for k in range(len(first))])
        raise FileNotFoundError(f"no workbook with rows in {self.options['path']}")

    def reader(self, schema: T.StructType) -> WorkbookReader:
        return WorkbookReader(schema, self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(schema, self.options)


def _strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read(spark: SparkSession, path: str, header: bool = True, columns: list[str] | None = None) -> DataFrame:
    spark.dataSource.register(WorkbookSource)
    r = spark.read.format(FORMAT).option("path", path).option("header", str(header).lower())
    return (r.option("columns", ",".join(columns)) if columns else r).load()


def write(df: DataFrame, path: str, header: bool = True, sheet_rows: int = SHEET_ROWS) -> None:
    """Workbooks of a frame's columns as text, one for each task."""
    df.sparkSession.dataSource.register(WorkbookSource)
    text = df.select(*(df[c].cast("string").alias(c) for c in df.columns))
    text.write.format(FORMAT).option("path", path).option("header", str(header).lower()).option("sheet_rows", sheet_rows).mode("append").save()
