"""Spreadsheet files as one distributed table of cells.

A task lists the files, so the driver holds none of their names, and other tasks
are handed them; the only Python is listing and unpacking the zipped XML of one
sheet. Rows stream out in batches, so a sheet never sits in a worker as a whole
table.
"""

from __future__ import annotations

import io
import os
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File pattern, preferred sheet, Excel's built-in date formats, day 0.
FILE_PATTERN = "PostAnalytics_*.xlsx"
SHEET = "PERFORMANCE"
DATE_FORMAT_IDS = frozenset({*range(14, 23), *range(45, 48)})
DAY_ZERO = datetime(1899, 12, 30)

CELL_SCHEMA = "file string, row int, col int, value string, ctype string, error string"
BATCH_ROWS = 10_000
#: Tasks for each core that read a folder of many files.
TASKS_OF_A_CORE = 16


def read_sheet_cells(
    spark: SparkSession, folder: str, pattern: str = FILE_PATTERN, sheet: str = SHEET, recursive: bool = False
) -> DataFrame:
    """Cells of one sheet per workbook: ``file, row, col, value, ctype, error``.

    The named sheet is read, or the first one where a workbook has none of that
    name. A file that cannot be read gives a single row with ``error`` set; an
    empty sheet counts as unreadable. See :func:`split_bad_files`. Sub-folders
    are read only with ``recursive``.
    """
    # Spark deals small files a few dozen to a task: a folder of many would be mostly the starting of tasks.
    tasks = TASKS_OF_A_CORE * spark.sparkContext.defaultParallelism
    files = file_names(spark, folder, pattern, recursive).repartition(tasks)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, stores = [], {}
        for batch in batches:
            for root, path in zip(batch["root"], batch["path"]):
                if root not in stores:
                    stores[root] = _store(root)
                store, base = stores[root]
                with store.open_input_file(base + path[len(root):]) as f:
                    content = f.read()
                for some in _cell_batches(path, content, sheet):
                    rows += some
                    if len(rows) >= BATCH_ROWS:
                        yield _frame(rows)
                        rows = []
        if rows:
            yield _frame(rows)

    return files.mapInPandas(unpack, CELL_SCHEMA)


def file_names(spark: SparkSession, folder: str, pattern: str, recursive: bool = False) -> DataFrame:
    """``root, path`` of the files of a folder (or of all a glob finds) whose name matches ``pattern``, as Spark lists them.

    Each root is listed by a task, and only the roots' names are on the driver. Hidden files are left out; of sub-folders
    only those named ``column=value`` are looked into, or all with ``recursive``.
    """
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    roots = path.getFileSystem(context._jsc.hadoopConfiguration()).globStatus(path)
    if not roots:
        return spark.read.format("binaryFile").load(folder)  # says that there is no such folder
    wanted = hadoop.GlobPattern(pattern).compiled().pattern()
    found = [(r.getPath().toString(), r.isDirectory()) for r in roots]

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = re.compile(wanted, re.DOTALL).fullmatch
        for batch in batches:
            for root, is_folder in zip(*(c.to_pylist() for c in batch.columns)):
                some: list[str] = []
                for name in _listed(*_store(root), recursive) if is_folder else [""]:
                    if match((name or root).rpartition("/")[2]):
                        some.append(root + name)
                    if len(some) == BATCH_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array([root] * len(some)), pa.array(some)], names=["root", "path"])
                        some = []
                yield pa.RecordBatch.from_arrays([pa.array([root] * len(some), pa.string()), pa.array(some, pa.string())],
                                                 names=["root", "path"])

    listed = spark.createDataFrame(found, "root string, is_folder boolean")
    return listed.mapInArrow(names, "root string, path string")


def _store(root: str) -> tuple[fs.FileSystem, str]:
    """File system of a path as Hadoop writes it, and the path there."""
    if root.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/+", "/", root)
    return fs.FileSystem.from_uri(root)


def _listed(store: fs.FileSystem, base: str, recursive: bool) -> Iterator[str]:
    """Files below ``base``, each as ``/name``; a local folder is read entry by entry."""
    todo = [""]
    while todo:
        below = todo.pop()
        if isinstance(store, fs.LocalFileSystem):
            with os.scandir(f"{base}{below}") as entries:
                kinds = ((e.name, e.is_dir()) for e in entries)
                yield from _visible(kinds, below, todo, recursive)
        else:
            entries = store.get_file_info(fs.FileSelector(f"{base}{below}"))
            yield from _visible(((e.base_name, e.type == fs.FileType.Directory) for e in entries), below, todo, recursive)


def _visible(entries: Iterator[tuple[str, bool]], below: str, todo: list[str], recursive: bool) -> Iterator[str]:
    for name, is_folder in entries:
        hidden = (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")
        if hidden:
            continue
        if not is_folder:
            yield f"{below}/{name}"
        elif recursive or "=" in name:
            todo.append(f"{below}/{name}")


def split_bad_files(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(cells of readable files, file and error of the others)``.

    A file that fails half-way has emitted cells already; they are left out.
    """
    bad = cells.where(F.col("error").isNotNull()).select("file", "error")
    good = cells.where(F.col("error").isNull()).drop("error")
    return good.join(bad.select("file"), "file", "left_anti"), bad


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["file", "row", "col", "value", "ctype", "error"])
    return out.astype({"row": "Int32", "col": "Int32"})


def _cell_batches(path: str, content: bytes, sheet: str) -> Iterator[list[tuple]]:
    rows, seen = [], False
    try:
        for r, c, value, ctype in _sheet_cells(content, sheet):
            rows.append((path, r, c, value, ctype, None))
            seen = True
            if len(rows) >= BATCH_ROWS:
                yield rows
                rows = []
        if not seen:
            raise ValueError("empty sheet")
    except Exception as e:  # noqa: BLE001 - any defect of one file must not stop the others
        rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
    if rows:
        yield rows


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(node) -> str:
    """Text of a string item: its runs, without phonetic hints."""
    parts = [node] if _local(node.tag) == "t" else node
    out = []
    for part in parts:
        kind = _local(part.tag)
        if kind == "t":
            out.append(part.text or "")
        elif kind == "r":
            out.extend(t.text or "" for t in part if _local(t.tag) == "t")
    return "".join(out)


def _items(book: zipfile.ZipFile, part: str, name: str) -> Iterator:
    """Elements ``name`` of a part, each released after use."""
    if part in book.namelist():
        with book.open(part) as f:
            for _, node in ElementTree.iterparse(f):
                if _local(node.tag) == name:
                    yield node
                    node.clear()


def _sheet_part(book: zipfile.ZipFile, wanted: str) -> str:
    sheets = [
        (n.get("name"), next(v for k, v in n.attrib.items() if _local(k) == "id"))
        for n in _items(book, "xl/workbook.xml", "sheet")
    ]
    rel = next((rid for name, rid in sheets if name == wanted), sheets[0][1])
    target = next(
        n.get("Target") for n in _items(book, "xl/_rels/workbook.xml.rels", "Relationship") if n.get("Id") == rel
    )
    return target.lstrip("/") if target.startswith("/") else posixpath.join("xl", target)


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Indexes of the cell styles that show a number as a date or time."""
    formats = {
        int(n.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", n.get("formatCode") or "")
        for n in _items(book, "xl/styles.xml", "numFmt")
    }
    custom = {i for i, code in formats.items() if re.search(r"[ymdhs]", code, re.IGNORECASE)}
    wanted, styles = DATE_FORMAT_IDS | custom, set()
    for block in _items(book, "xl/styles.xml", "cellXfs"):
        styles = {i for i, xf in enumerate(block) if int(xf.get("numFmtId") or 0) in wanted}
    return styles


def _column(ref: str) -> int:
    n = 0
    for ch in ref:
        if ch.isalpha():
            n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _sheet_cells(content: bytes, sheet: str) -> Iterator[tuple[int, int, str, str]]:
    """``row, col, value, ctype`` of the filled cells of one sheet."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = [_texts(n) for n in _items(book, "xl/sharedStrings.xml", "si")]
        dates = _date_styles(book)
        next_row = 0
        for row in _items(book, _sheet_part(book, sheet), "row"):
            r = int(row.get("r") or next_row + 1) - 1
            next_row, next_col = r + 1, 0
            for cell in row:
                c = _column(cell.get("r")) if cell.get("r") else next_col
                next_col = c + 1
                read = _cell(cell, shared, dates)
                if read is not None:
                    yield r, c, *read


def _cell(cell, shared: list[str], dates: set[int]) -> tuple[str, str] | None:
    kind, raw = cell.get("t") or "n", None
    for part in cell:
        if _local(part.tag) == "v":
            raw = part.text
        elif _local(part.tag) == "is":
            return _texts(part), "string"
    if raw is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(raw)], "string"
    if kind == "b":
        return ("True" if raw == "1" else "False"), "boolean"
    if kind == "d":
        return raw, "datetime"
    if kind == "str":
        return raw, "string"
    if int(cell.get("s") or 0) in dates:
        stamp = DAY_ZERO + timedelta(seconds=round(float(raw) * 86_400))
        return stamp.isoformat(sep=" ", timespec="seconds"), "datetime"
    return raw, "number"
