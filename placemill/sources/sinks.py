"""Exports: CSV text that spreadsheets read right, XLSX workbooks, and their names.

CSV cells are rendered by column expressions, since Spark's own CSV writer quotes differently, and sheet rows in Arrow batches. Rows are ordered by the
caller. A single file is what a person opens: tasks write it together (``onefile``), so no row passes the driver; ``csv_chunks`` streams rows
through the driver for a caller that sends them on, and ``write_csv_parts`` leaves the parts apart for what no person opens.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemill import ship
from placemill.functions.text import cell_text, csv_cell, number_text
from placemill.schema import ENRICHMENT_COLUMNS, LEAD_COLUMNS, PLACE_COLUMNS, filled
from placemill.sources.onefile import joined_crc, numbered, write_one

BOM, CRLF = "﻿", "\r\n"


def export_columns(df: DataFrame, columns: list[str] | None = None, extra: list[str] | None = None) -> list[str]:
    """The asked columns, or the schema, enrichment if any row has some, and extras."""
    if columns is not None:
        return columns
    have = [c for c in ENRICHMENT_COLUMNS if c in df.columns]
    enriched = bool(have) and bool(df.agg(F.bool_or(F.greatest(*(filled(c) for c in have)) if len(have) > 1 else filled(have[0]))).first()[0])
    return [*PLACE_COLUMNS, *(ENRICHMENT_COLUMNS if enriched else []), *(extra or [])]


def used_columns(df: DataFrame) -> list[str]:
    """Schema columns with a value in some row, in schema order, in one pass."""
    have = [c for c in PLACE_COLUMNS if c in df.columns]
    kinds = dict(df.dtypes)
    value = lambda c: F.col(c).isNotNull() & (F.col(c) != "") if kinds[c] == "string" else F.col(c).isNotNull()
    row = df.agg(*(F.coalesce(F.bool_or(value(c)), F.lit(False)).alias(c) for c in have)).first()
    return [c for c in have if row[c]]


def csv_line(df: DataFrame, columns: list[str]) -> Column:
    kinds = dict(df.dtypes)
    return F.concat_ws(",", *(csv_cell(cell_text(F.col(c), kinds[c])) if c in kinds else F.lit("") for c in columns))


def csv_header(columns: list[str]) -> str:
    def cell(text: str) -> str:
        body = f"\t{text}" if re.match(r"[=@\t\r]|[+\-][A-Za-z(|]", text) else text
        return '"' + body.replace('"', '""') + '"' if re.search('[",\n\r]', body) else body

    return ",".join(map(cell, columns))


def csv_chunks(df: DataFrame, columns: list[str] | None = None, extra: list[str] | None = None) -> Iterator[str]:
    """A CSV file in pieces: mark, header, rows; every line ended."""
    columns = export_columns(df, columns, extra)
    yield BOM + csv_header(columns) + CRLF
    for row in df.select(csv_line(df, columns).alias("line")).toLocalIterator(prefetchPartitions=True):
        yield row.line + CRLF


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, extra: list[str] | None = None) -> int:
    """To one file in a folder that driver and executors share; the number of rows."""
    columns = export_columns(df, columns, extra)
    head = (BOM + csv_header(columns) + CRLF).encode()
    return write_one(df.select(F.concat(csv_line(df, columns), F.lit(CRLF))), path, lambda f, size, crc: f.write(head))


def write_csv_parts(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """As many files as partitions, without header, on any file system."""
    df.select(csv_line(df, export_columns(df, columns)).alias("value")).write.option("lineSep", CRLF).text(path)


_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def xml_text(text: str) -> str:
    for sign, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot")):
        text = text.replace(sign, f"&{name};")
    return _CONTROL.sub("", text)


def sheet_cell(value: object) -> str:
    """A number, an inline string, or an empty cell."""
    if value is None or value == "":
        return "<c/>"
    if isinstance(value, bool):
        value = "true" if value else "false"
    if isinstance(value, int | float) and abs(value) != float("inf") and value == value:
        return f"<c><v>{number_text(value)}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{xml_text(number_text(value) if isinstance(value, float) else str(value))}</t></is></c>'


_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_OFFICE = "http://schemas.openxmlformats.org"


def _relations(*targets: tuple[str, str]) -> str:
    inner = "".join(f'<Relationship Id="rId{i}" Type="{_OFFICE}/officeDocument/2006/relationships/{kind}" Target="{target}"/>' for i, (kind, target) in enumerate(targets, 1))
    return f'{_HEAD}<Relationships xmlns="{_OFFICE}/package/2006/relationships">{inner}</Relationships>'


_SHEET = "xl/worksheets/sheet1.xml"


def sheet_row(n: int, values: Iterable[object]) -> str:
    return f'<row r="{n}">{"".join(map(sheet_cell, values))}</row>'


def _sheet_ends(columns: list[str]) -> tuple[bytes, bytes]:
    return f'{_HEAD}<worksheet xmlns="{_OFFICE}/spreadsheetml/2006/main"><sheetData>{sheet_row(1, columns)}'.encode(), b"</sheetData></worksheet>"


def _describe(z: zipfile.ZipFile, sheet: str) -> None:
    """All of a workbook of one sheet but the sheet."""
    types = {"/xl/workbook.xml": "sheet.main", f"/{_SHEET}": "worksheet"}
    overrides = "".join(f'<Override PartName="{p}" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.{t}+xml"/>' for p, t in types.items())
    defaults = '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    z.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_OFFICE}/package/2006/content-types">{defaults}{overrides}</Types>')
    z.writestr("_rels/.rels", _relations(("officeDocument", "xl/workbook.xml")))
    z.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_OFFICE}/spreadsheetml/2006/main" xmlns:r="{_OFFICE}/officeDocument/2006/relationships"><sheets><sheet name="{xml_text(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
    z.writestr("xl/_rels/workbook.xml.rels", _relations(("worksheet", "worksheets/sheet1.xml")))


def write_xlsx(rows: Iterable[dict[str, object]], columns: list[str], to: str | BinaryIO, sheet: str = "Leads") -> int:
    """A workbook of one sheet of rows at hand, stored without compression."""
    n, (head, tail) = 0, _sheet_ends(columns)
    with zipfile.ZipFile(to, "w", zipfile.ZIP_STORED) as z:
        _describe(z, sheet)
        with z.open(_SHEET, "w", force_zip64=True) as f:
            f.write(head)
            for n, row in enumerate(rows, 1):  # noqa: B007
                f.write(sheet_row(n + 1, (row.get(c) for c in columns)).encode())
            f.write(tail)
    return n


def write_workbook(rows: DataFrame, columns: list[str], path: str, sheet: str = "Leads") -> int:
    """A workbook of one sheet of ordered ``rows``, whose rows tasks write; the sheet's checksum is made of theirs, and the driver writes the archive around a gap."""
    head, tail = _sheet_ends(columns)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"line": [sheet_row(r["n"] + 1, (r["whole"].get(c) for c in columns)) for r in batch.to_pylist()]}, pa.schema([("line", pa.string())]))

    def around(f: BinaryIO, size: int, crc: int) -> int:
        with zipfile.ZipFile(f, "w", zipfile.ZIP_STORED) as z:
            _describe(z, sheet)
            entry = zipfile.ZipInfo(_SHEET)
            entry.file_size = entry.compress_size = len(head) + size + len(tail)
            entry.CRC = joined_crc(joined_crc(zlib.crc32(head), crc, size), zlib.crc32(tail), len(tail))
            entry.header_offset = f.seek(z.start_dir)
            f.write(entry.FileHeader(zip64=entry.file_size > zipfile.ZIP64_LIMIT))
            f.write(head)
            start = f.tell()
            f.seek(size, io.SEEK_CUR)
            f.write(tail)
            z.filelist.append(entry)
            z.start_dir = f.tell()  # where the directory goes on closing
        return start

    ship(rows.sparkSession)
    return write_one(numbered(rows).mapInArrow(lines, "line string"), path, around)


def write_leads(leads: DataFrame, path: str) -> int:
    return write_workbook(leads, LEAD_COLUMNS, path)


def file_name(label: str, day: str, kind: str, most: int = 50, prefix: str = "", fallback: str = "export") -> str:
    slug = re.sub("^-|-$", "", re.sub("[^a-z0-9]+", "-", label.lower()))[:most] or fallback
    return f"{prefix}{slug}-{day}.{kind}"
