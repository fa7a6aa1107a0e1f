"""Spreadsheets: ``format("xlsx_rows")`` reads them row by row, ``format("xlsx")`` writes rows into workbooks.

Small workbooks are read and written by a task each, or many by one, which streams
their rows.  A large sheet is read by ranges of its XML, whose tasks unpack what
lies before without parsing it, and written by ranges of its rows, which are packed
on their own (deflated data may be joined).  Cells are texts or numbers; formulas are not evaluated, their stored values are read.
"""

from __future__ import annotations

import io
import json
import re
import time
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from xml.etree import ElementTree
from xml.parsers import expat
from zipfile import ZIP_DEFLATED, ZipFile, ZipInfo

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, InputPartition

from ..functions import text as T
from .files import FileReader, dealt, files
from .named import NamedWriter, copy_parts, runs, write_files, write_large

#: Namespaces of the format.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_ROW, _C, _V, _T = (f"{MAIN} {tag}" for tag in ("row", "c", "v", "t"))
_HEAD, _ROW_TAG = re.compile(rb"<(?:[\w.-]+:)?sheetData(?:\s[^>]*)?>"), re.compile(rb"<(?:[\w.-]+:)?row(?:\s[^>]*)?>")
_POLYNOMIAL = 0xEDB88320
#: Bytes of XML for a task, ranges of a sheet at most, bytes that are unpacked at once, and how hard rows are packed.
SPLIT, RANGES, _READ, LEVEL = 1 << 26, 48, 1 << 20, 1


def place(ref: str) -> int:
    """Number of the column in a cell's name, from 0."""
    k = 0
    for letter in re.match("[A-Za-z]*", ref)[0].upper():
        k = 26 * k + ord(letter) - 64
    return k - 1


def letters(k: int) -> str:
    """The letters of a column: its place among those with as many letters, written in 26 digits."""
    n, first = 1, 0
    while k >= first + 26**n:
        first, n = first + 26**n, n + 1
    return "".join(chr(65 + (k - first) // 26**i % 26) for i in reversed(range(n)))


class _Rows:
    """The rows of a sheet's XML that is fed piece by piece; only the row that is being read is kept."""

    def __init__(self, shared: list[str]):
        self.shared, self.number, self.parser = shared, 0, expat.ParserCreate(namespace_separator=" ")
        self.done: list[tuple[int, list[str]]] = []
        self.text: list[str] | None = None  # of a value or of a text, while inside
        self.cells: list[str] | None = None
        self.columns: dict[str, int] = {}
        self.parser.buffer_text = True
        self.parser.StartElementHandler, self.parser.EndElementHandler, self.parser.CharacterDataHandler = self._start, self._end, self._data

    def _start(self, tag: str, has: dict) -> None:
        if tag == _T:
            self.text = []
        elif tag == _V:
            self.text = []
        elif tag == _C and self.cells is not None:
            self.kind, self.value, self.inline = has.get("t"), None, []
            name = has.get("r")
            if name:
                column = name.rstrip("0123456789")
                if column not in self.columns:
                    self.columns[column] = place(column)
                self.at = self.columns[column]
            else:
                self.at = len(self.cells)
        elif tag == _ROW:
            self.number = int(has.get("r") or self.number + 1)
            self.cells = []

    def _data(self, text: str) -> None:
        if self.text is not None:
            self.text.append(text)

    def _end(self, tag: str) -> None:
        if self.cells is None:
            return
        if tag == _T:
            self.inline += self.text
            self.text = None
        elif tag == _V:
            self.value, self.text = "".join(self.text) if self.value is None else self.value, None
        elif tag == _C:
            text = self.value or ""
            if self.kind == "inlineStr":
                text = "".join(self.inline)
            elif self.kind == "s" and text:
                text = self.shared[int(text)]
            self.cells += [""] * (self.at + 1 - len(self.cells))
            self.cells[self.at] = text
        elif tag == _ROW:
            self.done.append((self.number, self.cells))
            self.cells = None

    def feed(self, data: bytes) -> list[tuple[int, list[str]]]:
        """The rows that end with these bytes."""
        self.parser.Parse(data, False)
        out, self.done = self.done, []
        return out


def _shared(book: ZipFile) -> list[str]:
    """The texts that cells name by number."""
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    with book.open("xl/sharedStrings.xml") as file:
        return ["".join(t.text or "" for t in node.iter(f"{{{MAIN}}}t")) for _, node in ElementTree.iterparse(file) if node.tag == f"{{{MAIN}}}si"]


def _pieces(file) -> Iterator[tuple[int, bytes, bool]]:
    """(first byte, bytes, whether they are markup) of XML, one after the other: comments and CDATA are told apart, no tag's beginning is cut."""
    at, data, until = 0, b"", None
    while True:
        more = file.read(_READ)
        data += more
        while data:
            if until:
                end = data.find(until)
                size = end + len(until) if end >= 0 else max(0, len(data) - 2) if more else len(data)
            else:
                end = min((k for k in (data.find(b"<!--"), data.find(b"<![CDATA[")) if k >= 0), default=-1)
                last = data.rfind(b"<")
                size = end if end >= 0 else last if more and last >= 0 else len(data)
            if size:
                yield at, data[:size], until is None
            at, data = at + size, data[size:]
            if end < 0:
                break
            until = None if until else b"-->" if data.startswith(b"<!--") else b"]]>"
        if not more:
            return


def _number_before(book: ZipFile, sheet: str, before: int) -> int:
    """The number of the last row that begins before a byte."""
    number = 0
    with book.open(sheet) as file:
        for at, data, markup in _pieces(file):
            for m in _ROW_TAG.finditer(data) if markup and at < before else ():
                if at + m.start() < before:
                    named = re.search(rb"""\sr\s*=\s*["'](\d+)""", m[0])
                    number = int(named[1]) if named else number + 1
            if at >= before:
                break
    return number


def sheet_rows(book: ZipFile, sheet: str, first: int = 0, end: float = float("inf")) -> Iterator[list[tuple[int, list[str]]]]:
    """(row, cells) of those rows of a sheet, empty cells as empty texts, whose tags begin from the byte ``first`` of its XML on, before ``end``; lists of them.

    What lies before is unpacked but not parsed.  A sheet whose rows can't be told so belongs to the first range.
    """
    rows = _Rows(_shared(book))
    with book.open(sheet) as file:
        head = _HEAD.search(file.read(_READ))
        cut = first > 0
    if head is None:
        if cut:
            return
        end = float("inf")
    with book.open(sheet) as file:
        if cut:
            rows.feed(head.string[: head.end()])
        for at, data, markup in _pieces(file):
            if cut:  # not begun
                if not markup or at + len(data) <= first:
                    continue
                begin = next((m for m in _ROW_TAG.finditer(data) if at + m.start() >= first), None)
                if begin is None:
                    continue
                if at + begin.start() >= end:
                    return
                if not re.search(rb"\sr\s*=", begin[0]):
                    rows.number = _number_before(book, sheet, at + begin.start())
                at, data, cut = at + begin.start(), data[begin.start() :], False
            if markup and at + len(data) > end:
                last = next((m for m in _ROW_TAG.finditer(data) if at + m.start() >= end), None)
                if last is not None:
                    yield rows.feed(data[: last.start()])
                    return
            yield rows.feed(data)
        if not cut:
            rows.parser.Parse(b"", True)
            yield rows.done


class _XlsxReader(FileReader):
    suffix = ".xlsx"

    def __init__(self, options: dict):
        super().__init__(options)
        self.sheets = [f"xl/worksheets/sheet{n}.xml" for n in options.get("sheets", "1").split(",")]
        self.split = int(options.get("split", SPLIT))

    def _sheet(self, book: ZipFile, name: str) -> str:
        there = [s for s in self.sheets if s in book.namelist()]
        if not there:
            raise ValueError(f"{name}: no such sheet")
        return there[0]

    def parts(self) -> tuple[list[tuple], list[int]]:
        parts, sizes = [], []
        for name, size in files(self.path, self.suffix):
            step, whole = None, size
            if size > self.split // 16:  # XML is packed to a tenth or so
                with self.open(name) as file, ZipFile(file) as book:
                    whole = book.getinfo(self._sheet(book, name)).file_size
                step = max(self.split, -(-whole // RANGES))
            firsts = range(0, max(whole, 1), step) if step else (0,)
            parts += [(name, a, a + step if step and a + step < whole else None) for a in firsts]
            sizes += [size // len(firsts)] * len(firsts)
        return parts, sizes

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(some) for some in dealt(*self.parts(), self.split // 16)] or [InputPartition([])]

    def read_part(self, name: str, first: int, end: int | None) -> Iterator[pa.RecordBatch]:
        with self.open(name) as file, ZipFile(file) as book:
            for rows in sheet_rows(book, self._sheet(book, name), first, float("inf") if end is None else end):
                if rows:
                    numbers, cells = zip(*rows, strict=True)
                    yield pa.record_batch([pa.array([name] * len(rows), pa.string()), pa.array(numbers, pa.int64()), pa.array(cells, pa.list_(pa.string()))], ["file", "row", "cells"])


class XlsxRows(DataSource):
    """Rows (file, row, cells) of a workbook, or of all in a folder; option sheets: numbers of sheets, the first that is there is read."""

    @classmethod
    def name(cls) -> str:
        return "xlsx_rows"

    def schema(self) -> str:
        return "file string, row long, cells array<string>"

    def reader(self, schema) -> _XlsxReader:
        return _XlsxReader(self.options)


def read_workbooks(spark: SparkSession, path: str, sheets: str = "1") -> DataFrame:
    spark.dataSource.register(XlsxRows)
    return spark.read.format("xlsx_rows").option("sheets", sheets).load(path)


def gps_speeds(spark: SparkSession, folder: str) -> DataFrame:
    """(video, cts, speed): speeds in m/s by time from ``*/telemetry_gps.xlsx``, video being the folder's name in lower case.

    Columns are found by their headers; the first sheet's speeds are in km/s.
    """
    rows = read_workbooks(spark, folder, "2,1").where(F.col("file").rlike("/telemetry_gps\\.xlsx$"))
    header = F.first("cells").over(Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    header = F.slice(header, 1, 12)
    time_at = F.greatest(F.array_position(header, "cts"), F.lit(1)).cast("int")
    named = F.transform(header, lambda h: h.contains("GPS (2D speed)"))
    speed_at = F.coalesce(F.nullif(F.array_position(named, True), F.lit(0)), F.lit(6)).cast("int")
    rows = rows.select(
        "*", F.row_number().over(Window.partitionBy("file").orderBy("row")).alias("k"), time_at.alias("a"), speed_at.alias("b"),
        F.coalesce(F.try_element_at(header, speed_at).contains("k/s"), F.lit(False)).alias("thousand"),
    )
    cell = lambda c: T.number(F.try_element_at("cells", c))
    out = rows.where("k > 1").select(
        F.lower(F.element_at(F.split("file", "/"), -2)).alias("video"), cell(F.col("a")).alias("cts"), (cell(F.col("b")) * F.when(F.col("thousand"), 1000.0).otherwise(1.0)).alias("speed")
    )
    return out.where("cts IS NOT NULL AND speed IS NOT NULL")


def _node(tag: str, *inside: ElementTree.Element, text: str | None = None, **attributes: object) -> ElementTree.Element:
    """An element; attributes that are None are left out."""
    out = ElementTree.Element(tag, {k.rstrip("_"): str(v) for k, v in attributes.items() if v is not None})
    out.text = text
    out.extend(inside)
    return out


def _xml(node: ElementTree.Element) -> bytes:
    return ElementTree.tostring(node, "utf-8")


def _many(tag: str, items: list[ElementTree.Element]) -> ElementTree.Element:
    return _node(tag, *items, count=len(items))


def _escaped(texts: pa.Array) -> pa.Array:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        texts = pc.replace_substring(texts, mark, name)
    return texts


def rows_xml(batch: pa.RecordBatch, first: int | None = None) -> bytes:
    """The rows of cells (structs of :func:`cell`), numbered from ``first`` or by their ``number``; a number of the size of exact integers has no point."""
    lists = batch["cells"]
    flat = lists.flatten()
    texts, numbers, styles = _escaped(flat.field("text")).to_pylist(), flat.field("number").to_pylist(), flat.field("style").to_pylist()
    places = range(first, first + batch.num_rows) if first is not None else batch["number"].to_pylist()
    out, k = [], 0
    for row, n in zip(places, lists.value_lengths().to_pylist(), strict=True):
        out.append(f'<row r="{row}">')
        for column in _columns(n or 0):
            number, style = numbers[k], styles[k]
            look = f' s="{style}"' if style else ""
            if number is None:
                out.append(f'<c r="{column}{row}"{look} t="inlineStr"><is><t>{texts[k] or ""}</t></is></c>')
            else:
                out.append(f'<c r="{column}{row}"{look}><v>{int(number) if number.is_integer() and abs(number) < 2**50 else repr(number)}</v></c>')
            k += 1
        out.append("</row>")
    return "".join(out).encode()


@cache
def _columns(n: int) -> list[str]:
    return [letters(k) for k in range(n)]


#: Looks of cells: font, fill and edges by their places in the style sheet.
PLAIN, TITLE = 0, 1


def _styles(formats: list[str]) -> ElementTree.Element:
    """The style sheet: 0 is plain, 1 a title, and from 2 on plain cells of each number format ("" is general)."""
    font = lambda **more: _node("font", *(_node(k, val=v) for k, v in more.items()), _node("sz", val=10), _node("name", val="Arial"))
    fill = lambda kind, *colour: _node("fill", _node("patternFill", *colour, patternType=kind))
    line = _node("bottom", _node("color", rgb="FF4F81BD"), style="medium")
    numbered = {code: 200 + k for k, code in enumerate(dict.fromkeys(filter(None, formats)))}
    look = lambda k, code="", **more: _node("xf", *more.pop("inside", ()), numFmtId=numbered.get(code, 0), fontId=k, fillId=2 * k, borderId=k, applyNumberFormat=int(code in numbered), **more)
    title = look(TITLE, inside=(_node("alignment", wrapText=1, vertical="top"),), applyFont=1, applyFill=1, applyBorder=1, applyAlignment=1)
    parts = {
        "numFmts": [_node("numFmt", numFmtId=k, formatCode=code) for code, k in numbered.items()],
        "fonts": [font(), font(b=1)],
        "fills": [fill("none"), fill("gray125"), fill("solid", _node("fgColor", rgb="FFDCE6F1"))],  # the format fixes the first two
        "borders": [_node("border"), _node("border", line)],
        "cellXfs": [look(PLAIN), title, *(look(PLAIN, code) for code in formats)],
    }
    return _node("styleSheet", *(_many(tag, items) for tag, items in parts.items() if items), xmlns=MAIN)


def _around(layout: dict) -> tuple[list[ElementTree.Element], list[ElementTree.Element]]:
    """What stands before and behind the rows of a sheet: the fixed first row and widths; the choices of cells."""
    before, behind = [], []
    if layout.get("frozen", True):
        before.append(_node("sheetViews", _node("sheetView", _node("pane", ySplit=1, topLeftCell="A2", state="frozen"), workbookViewId=0)))
    if layout.get("widths"):
        before.append(_node("cols", *(_node("col", min=a, max=b, width=w, customWidth=1) for a, b, w in layout["widths"])))
    if layout.get("lists"):
        choice = lambda values: _node("formula1", text='"' + ",".join(values) + '"')
        behind.append(_many("dataValidations", [_node("dataValidation", choice(values), type="list", sqref=where, allowBlank=1, showErrorMessage=1) for where, values in layout["lists"].items()]))
    return before, behind


def _links(of: list[tuple[str, str]]) -> ElementTree.Element:
    """Relations r1, r2, ... to (kind, target)."""
    return _node("Relationships", *(_node("Relationship", Id=f"r{k}", Type=f"{RELATIONS}/{kind}", Target=target) for k, (kind, target) in enumerate(of, 1)), xmlns=f"{PACKAGE}/relationships")


def _times(a: int, b: int) -> int:
    """The product of two polynomials over two elements modulo that of crc32, the highest bit the constant."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


def joined_crc(a: int, b: int, size: int) -> int:
    """The crc32 of two texts, one behind the other, from those of both and the bytes of the second."""
    power, square, n = 1 << 31, 1 << 23, size  # x to the 0 and to the 8
    while n:
        power = _times(power, square) if n & 1 else power
        square, n = _times(square, square), n >> 1
    return _times(power, a) ^ b


def packed(pieces: Iterable[bytes], out, last: bool = False) -> dict:
    """Write pieces as deflated bytes that others may follow; their crc, size and packed size."""
    deflate, crc, size, written = zlib.compressobj(LEVEL, zlib.DEFLATED, -15), 0, 0, 0
    for piece in pieces:
        crc, size, data = zlib.crc32(piece, crc), size + len(piece), deflate.compress(piece)
        written += len(data)
        out.write(data)
    data = deflate.flush(zlib.Z_FINISH if last else zlib.Z_FULL_FLUSH)
    out.write(data)
    written += len(data)
    return {"crc": crc, "size": size, "packed": written}


@cache
def _around_sheets(names: tuple[str, ...], formats: tuple[str, ...]) -> list[tuple[str, bytes]]:
    """(name, bytes) of what a workbook has besides its sheets."""
    sheets = [f"worksheets/sheet{k}.xml" for k in range(1, len(names) + 1)]
    listed = _node("sheets", *(_node("sheet", **{"name": n, "sheetId": k, "r:id": f"r{k}"}) for k, n in enumerate(names, 1)))
    kinds = {"workbook.xml": "sheet.main", "styles.xml": "styles"} | dict.fromkeys(sheets, "worksheet")
    default = [_node("Default", Extension=e, ContentType=t) for e, t in (("rels", "application/vnd.openxmlformats-package.relationships+xml"), ("xml", "application/xml"))]
    parts = {
        "xl/styles.xml": _styles(list(formats)),
        "xl/workbook.xml": _node("workbook", listed, **{"xmlns": MAIN, "xmlns:r": RELATIONS}),
        "xl/_rels/workbook.xml.rels": _links([*(("worksheet", s) for s in sheets), ("styles", "styles.xml")]),
        "_rels/.rels": _links([("officeDocument", "xl/workbook.xml")]),
        "[Content_Types].xml": _node("Types", *default, *(_node("Override", PartName=f"/xl/{part}", ContentType=f"{_TYPE}.{kind}+xml") for part, kind in kinds.items()), xmlns=f"{PACKAGE}/content-types"),
    }
    return [(where, _xml(node)) for where, node in parts.items()]


class _XlsxWriter(NamedWriter):
    def fill(self, out, batches: Iterator[pa.RecordBatch]) -> None:
        layout, names = json.loads(self.options.get("layout", "{}")), []
        before, behind = (b"".join(map(_xml, nodes)) for nodes in _around(layout))
        before, behind = f'<worksheet xmlns="{MAIN}">'.encode() + before + b"<sheetData>", b"</sheetData>" + behind + b"</worksheet>"
        with ZipFile(out, "w", ZIP_DEFLATED, compresslevel=LEVEL) as book:
            for sheet, own in runs(batches, "sheet"):
                names.append(sheet)
                where = f"xl/worksheets/sheet{len(names)}.xml"
                if self.options.get("parts"):
                    self._join(book, where, before, behind, list(own))
                    continue
                with book.open(where, "w", force_zip64=True) as file:
                    file.write(before)
                    number = 1
                    for k, batch in enumerate(own):
                        if not k and "head" in batch.schema.names:
                            file.write(rows_xml(pa.record_batch([batch["head"].slice(0, 1)], ["cells"]), number))
                            number += 1
                        file.write(rows_xml(batch, number))
                        number += batch.num_rows
                    file.write(behind)
            for where, data in _around_sheets(tuple(names), tuple(layout.get("formats", ()))):
                book.writestr(where, data)

    def _join(self, book: ZipFile, where: str, before: bytes, behind: bytes, batches: list[pa.RecordBatch]) -> None:
        """A sheet from parts that are packed already: one row a part."""
        start, end = io.BytesIO(), io.BytesIO()
        known = [packed([before], start), *(row for batch in batches for row in batch.select(["crc", "size", "packed"]).to_pylist()), packed([behind], end, last=True)]
        info = ZipInfo(where, time.localtime()[:6])
        info.compress_type, info.header_offset = ZIP_DEFLATED, book.fp.tell()
        info.file_size, info.compress_size = (sum(k[c] for k in known) for c in ("size", "packed"))
        info.CRC = 0
        for k in known:
            info.CRC = joined_crc(info.CRC, k["crc"], k["size"])
        book.fp.write(info.FileHeader())
        book.fp.write(start.getvalue())
        copy_parts(book.fp, batches)
        book.fp.write(end.getvalue())
        book.filelist.append(info)
        book.NameToInfo[where] = info
        book.start_dir = book.fp.tell()


class Xlsx(DataSource):
    """Rows (name, sheet, cells) as workbooks of those names; option layout: JSON of frozen, widths, lists and formats.

    With a column head, the first row's are cells of a row before all; with the option
    parts, rows (name, sheet, part, crc, size, packed) name files of packed rows instead.
    """

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def writer(self, schema, overwrite: bool) -> _XlsxWriter:
        return _XlsxWriter(self.options)


def cell(value: Column, kind: str, style: int = 0) -> Column:
    """A cell: a number or a text; nulls and what is not finite are empty."""
    finite = value.isNotNull() & ~F.isnan(value.cast("double")) & (F.abs(value.cast("double")) < float("inf")) if kind == "number" else F.lit(False)
    number = F.when(finite, value.cast("double")) if kind == "number" else F.lit(None).cast("double")
    text = F.lit(None).cast("string") if kind == "number" else value.cast("string")
    return F.struct(text.alias("text"), number.alias("number"), F.lit(style).alias("style"))


def texts(values: Iterable[str], style: int = 0) -> Column:
    """Cells of fixed texts."""
    return F.array(*(cell(F.lit(v), "text", style) for v in values))


def cells_of(rows: DataFrame, styles: dict[str, int] | None = None) -> Column:
    """All columns of ``rows`` as cells: numbers as such, all else as text."""
    number = {"int", "bigint", "smallint", "tinyint", "float", "double"}
    return F.array(*(cell(F.col(f"`{c}`"), "number" if t in number else "text", (styles or {}).get(c, 0)) for c, t in rows.dtypes))


def write_workbooks(rows: DataFrame, path: str, order: list[str], layout: dict | None = None) -> None:
    """Write rows(name, sheet, cells) as workbooks under ``path``; sheets and their rows are in order of the columns ``order``."""
    rows.sparkSession.dataSource.register(Xlsx)
    write_files(rows, path, "xlsx", order, layout=json.dumps(layout or {}))


def write_large_workbooks(rows: DataFrame, path: str, sheet: str, layout: dict | None = None) -> None:
    """As :func:`write_workbooks`, of one sheet each, which many tasks write: rows(name, number, cells) know the numbers of their rows."""
    rows.sparkSession.dataSource.register(Xlsx)
    fill = lambda out, batches: {"sheet": sheet, **packed(map(rows_xml, batches), out)}
    write_large(rows.withColumn("_o", F.col("number")), path, "xlsx", ["_o"], fill, ", sheet string, crc long, size long, packed long", layout=json.dumps(layout or {}))
