"""A data source of files, planned from names and sizes before any content is read, and exports written as one file.

`spark.read.format("document_files").load(folder)` lists a folder, keeps files by their name or type and their size, gives
each its place in the order of names, and packs them into partitions of bounded size; only the tasks open them.
`df.write.format("single_csv")` and `"single_xlsx"` write parts on the executors; the commit, which runs once after all
tasks have succeeded, puts them together as one dated file, and an abort leaves nothing behind. Parts and files are
streamed in pieces, never held whole. Any file system that pyarrow reaches from driver and executors will do.
"""

from __future__ import annotations

import contextlib
import mimetypes
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, date, datetime
from xml.sax.saxutils import escape

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..constants import BOM, MAX_FILE_BYTES

#: Bytes of files that one partition reads, and of a file that one step copies.
PARTITION_BYTES, PIECE = 64 << 20, 1 << 20
PDF = "application/pdf"
SHEET_ROWS = 1_048_576


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path within it of a path or URI."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def is_document(name: str, mime: str | None) -> bool:
    """S1 for one name: by type or by extension, without case."""
    return mime == PDF or name.lower().endswith(".pdf")


@dataclass
class Files(InputPartition):
    """(place in the order of names, path, size, when changed) of the files that a task reads."""

    files: list[tuple[int, str, int, datetime]]


class FileReader(DataSourceReader):
    """Options, by their names in lower case: path, maxFileBytes, partitionBytes."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.limit = int(options.get("maxfilebytes", MAX_FILE_BYTES))
        self.partition_bytes = int(options.get("partitionbytes", PARTITION_BYTES))

    def partitions(self) -> list[Files]:
        """Files that qualify, numbered by name, in groups of bounded size; nothing is opened."""
        fs, path = file_system(self.path)
        found = [f for f in fs.get_file_info(pafs.FileSelector(path, recursive=True)) if f.is_file and is_document(f.base_name, mimetypes.guess_type(f.base_name)[0]) and f.size <= self.limit]
        out: list[Files] = []
        room = 0
        for place, f in enumerate(sorted(found, key=lambda f: f.path)):
            if room < f.size or not out:
                out.append(Files([]))
                room = self.partition_bytes
            out[-1].files.append((place, f.path, f.size, f.mtime or datetime.fromtimestamp(0, UTC)))
            room -= f.size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, _ = file_system(self.path)
        for place, path, size, changed in partition.files:
            with fs.open_input_stream(path) as f:
                yield place, path, path.rsplit("/", 1)[-1], size, changed, f.read()


class DocumentFiles(DataSource):
    """file_idx, doc_id (the path), name, size, added_at and content of the documents below a folder."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return "file_idx long, doc_id string, name string, size long, added_at timestamp, content binary"

    def reader(self, schema: StructType) -> FileReader:
        return FileReader(dict(self.options))


@dataclass
class Part(WriterCommitMessage):
    """The part that a task has written, the task's number and the part's rows."""

    path: str
    task: int
    rows: int


class SingleFile(DataSourceWriter):
    """Parts of text on the executors, one file at the commit. Options, by their names in lower case: path (a folder),
    prefix, header and day (today if none)."""

    extension = ""

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        day = date.fromisoformat(options["day"]) if options.get("day") else datetime.now(UTC).date()
        self.folder, self.columns = options["path"], schema.names
        self.file = f"{options.get('prefix', 'export')}_{day:%Y-%m-%d}{self.extension}"
        self.header = options.get("header", ",".join(self.columns))
        self.parts = f"_parts-{uuid.uuid4().hex}"

    def text_of(self, row: tuple) -> str:
        raise NotImplementedError

    def assemble(self, fs: pafs.FileSystem, parts: list[Part], out) -> None:  # noqa: ANN001
        raise NotImplementedError

    def write(self, iterator: Iterator) -> Part:
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, folder = file_system(self.folder)
        fs.create_dir(f"{folder}/{self.parts}", recursive=True)
        path = f"{folder}/{self.parts}/{context.partitionId()}-{context.taskAttemptId()}"
        rows = 0
        with fs.open_output_stream(path) as f:
            for row in iterator:
                f.write((self.text_of(row) + "\n").encode())
                rows += 1
        return Part(path, context.partitionId(), rows)

    def commit(self, messages: list[Part | None]) -> None:
        fs, folder = file_system(self.folder)
        fs.create_dir(folder, recursive=True)
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.task)
        whole = f"{folder}/{self.parts}-whole"
        with fs.open_output_stream(whole) as out:
            self.assemble(fs, parts, out)
        fs.move(whole, f"{folder}/{self.file}")
        self._clear(fs, folder)

    def abort(self, messages: list[Part | None]) -> None:
        self._clear(*file_system(self.folder))

    def _clear(self, fs: pafs.FileSystem, folder: str) -> None:
        with contextlib.suppress(FileNotFoundError):
            fs.delete_dir(f"{folder}/{self.parts}")

    @staticmethod
    def pieces(fs: pafs.FileSystem, parts: list[Part]) -> Iterator[bytes]:
        for part in parts:
            with fs.open_input_stream(part.path) as f:
                while piece := f.read(PIECE):
                    yield piece


class CsvWriter(SingleFile):
    """Lines of CSV below one byte-order mark and one header, also where there are no lines."""

    extension = ".csv"

    def text_of(self, row: tuple) -> str:
        return row[0]

    def assemble(self, fs: pafs.FileSystem, parts: list[Part], out) -> None:  # noqa: ANN001
        out.write((BOM + self.header + "\n").encode())
        for piece in self.pieces(fs, parts):
            out.write(piece)


class SingleCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return "single_csv"

    def writer(self, schema: StructType, overwrite: bool) -> CsvWriter:
        if len(schema.names) != 1:
            raise ValueError("single_csv takes one column of CSV lines")
        return CsvWriter(dict(self.options), schema)


#: Fixed parts of a workbook.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml."
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


def cell(value) -> str:  # noqa: ANN001
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float) and value == value and abs(value) != float("inf"):
        return f"<c><v>{value!r}</v></c>"
    text = "".join(c if c >= " " or c in "\t\n" else f"_x{ord(c):04X}_" for c in str(value))
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text).replace(chr(10), "&#10;")}</t></is></c>'


def sheet_row(values: tuple | list[str]) -> str:
    return "<row>" + "".join(map(cell, values)) + "</row>"


class XlsxWriter(SingleFile):
    """A workbook of as many sheets as the rows need, each with the header; a row is one line of a part."""

    extension = ".xlsx"

    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        super().__init__(options, schema)
        self.sheet_rows = int(options.get("sheetrows", SHEET_ROWS)) - 1  # the header is one

    def text_of(self, row: tuple) -> str:
        return sheet_row(row)

    def assemble(self, fs: pafs.FileSystem, parts: list[Part], out) -> None:  # noqa: ANN001
        sheets = max(1, -(-sum(p.rows for p in parts) // self.sheet_rows))
        names = range(1, sheets + 1)
        rows = self._rows(fs, parts)
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
            book.writestr("[Content_Types].xml", f'{_XML}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPE}sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{_TYPE}worksheet+xml"/>' for i in names) + "</Types>")
            book.writestr("_rels/.rels", f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_DOC}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            book.writestr("xl/workbook.xml", f'{_XML}<workbook xmlns="{_MAIN}" xmlns:r="{_DOC}"><sheets>' + "".join(f'<sheet name="Sheet{i}" sheetId="{i}" r:id="rId{i}"/>' for i in names) + "</sheets></workbook>")
            book.writestr("xl/_rels/workbook.xml.rels", f'{_XML}<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_DOC}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in names) + "</Relationships>")
            for i in names:
                with book.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=True) as sheet:
                    sheet.write(f'{_XML}<worksheet xmlns="{_MAIN}"><sheetData>{sheet_row(self.columns)}'.encode())
                    for _, row in zip(range(self.sheet_rows), rows):  # noqa: B905  rows go on in the next sheet
                        sheet.write(row)
                    sheet.write(b"</sheetData></worksheet>")

    def _rows(self, fs: pafs.FileSystem, parts: list[Part]) -> Iterator[bytes]:
        rest = b""
        for piece in self.pieces(fs, parts):
            *lines, rest = (rest + piece).split(b"\n")
            yield from lines


class SingleXlsx(DataSource):
    @classmethod
    def name(cls) -> str:
        return "single_xlsx"

    def writer(self, schema: StructType, overwrite: bool) -> XlsxWriter:
        return XlsxWriter(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Make the formats known to a session."""
    for source in (DocumentFiles, SingleCsv, SingleXlsx):
        spark.dataSource.register(source)
