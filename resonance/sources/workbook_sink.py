"""Cells to workbook files: one small workbook per file name."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resonance.sources.workbook import SHEET

_RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def _reference(col: int, row: int) -> str:
    name = ""
    col += 1
    while col:
        col, digit = divmod(col - 1, 26)
        name = chr(65 + digit) + name
    return f"{name}{row + 1}"


def workbook_bytes(cells: list[tuple[int, int, str]], sheet: str = SHEET) -> bytes:
    """A workbook with one sheet of text cells ``(row, col, value)``."""
    rows: dict[int, list[str]] = {}
    for r, c, value in sorted(cells):
        text = f'<c r="{_reference(c, r)}" t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'
        rows.setdefault(r, []).append(text)
    data = "".join(f'<row r="{r + 1}">{"".join(cs)}</row>' for r, cs in rows.items())
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{_MAIN}" xmlns:r="{_RELS}"><sheets>'
            f'<sheet name="{escape(sheet)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
            f'<Relationship Id="rId1" Type="{_RELS}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        )
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{_MAIN}"><sheetData>{data}</sheetData></worksheet>')
    return out.getvalue()


def write_workbooks(cells: DataFrame, folder: str, prefix: str = "PostAnalytics_") -> DataFrame:
    """Write ``file, row, col, value`` cells as workbooks; returns the paths (run it to write).

    A sheet is one file, so the cells of a file meet in one task; spreadsheet
    programs cap a sheet at about a million rows.
    """
    uri = folder if "://" in folder else f"file://{folder}"
    cell = F.struct(F.col("row"), F.col("col"), F.col("value"))
    books = cells.where(F.col("value").isNotNull()).groupBy("file").agg(F.collect_list(cell).alias("cells"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(uri)
        store.create_dir(base, recursive=True)
        for batch in batches:
            paths = []
            for name, entries in zip(batch["file"], batch["cells"]):
                path = f"{base}/{prefix}{name}.xlsx"
                with store.open_output_stream(path) as f:
                    f.write(workbook_bytes([(e["row"], e["col"], e["value"]) for e in entries]))
                paths.append(path)
            yield pd.DataFrame({"path": paths})

    return books.mapInPandas(write, "path string")
