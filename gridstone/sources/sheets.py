"""Excel workbooks (.xlsx) as tables: a task a sheet, read as a stream.

A workbook is a zip of XML; a sheet's rows are one compressed stream and can't be entered in
the middle, so that a sheet is a task, but no sheet is ever held whole: rows go out in
batches. Shared strings, of which a sheet needs all, are held by the task.

Defined cases: rows before the header are skipped; the header's empty cells name no column,
equal names get _2, _3, ...; cells that are absent or empty are null; numbers keep their text
as stored, booleans are true and false, errors null; rows without any value are left out;
paths must be readable by pyarrow from driver and executors.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .rowgroups import opened

#: The name spaces of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
BATCH = 4096


def _texts(node) -> str:
    """The text of a string item, its phonetic hints left out."""
    return "".join(t.text or "" for part in node if part.tag != f"{MAIN}rPh" for t in part.iter(f"{MAIN}t"))


def sheet_files(book: zipfile.ZipFile) -> dict[str, str]:
    """Sheet name -> its file, in the workbook's order."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = {}
    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
        target = links[s.get(LINK)]
        out[s.get("name")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    return out


def column_number(reference: str) -> int:
    """0 for A1, 26 for AA7."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def cells(book: zipfile.ZipFile, file: str) -> Iterator[dict[int, str]]:
    """The rows of a sheet as column -> text, rows that are absent as empty ones."""
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        with book.open("xl/sharedStrings.xml") as f:
            for _, node in ElementTree.iterparse(f):
                if node.tag == f"{MAIN}si":
                    shared.append(_texts(node))
                    node.clear()
    last = 0
    with book.open(file) as f:
        for _, row in ElementTree.iterparse(f):
            if row.tag != f"{MAIN}row":
                continue
            here = int(row.get("r") or last + 1)
            for _ in range(last + 1, here):
                yield {}
            last, found = here, {}
            for k, c in enumerate(row.iter(f"{MAIN}c")):
                kind, v, at = c.get("t"), c.find(f"{MAIN}v"), column_number(c.get("r")) if c.get("r") else k
                text = _texts(c.find(f"{MAIN}is")) if kind == "inlineStr" and c.find(f"{MAIN}is") is not None else v.text if v is not None else None
                if text and kind == "s":
                    text = shared[int(text)]
                elif text and kind == "b":
                    text = "true" if text == "1" else "false"
                if text and kind != "e":
                    found[at] = text
            row.clear()
            yield found


def header_names(row: dict[int, str]) -> dict[int, str]:
    """Column -> name, equal names numbered."""
    out: dict[int, str] = {}
    for at in sorted(row):
        name = row[at].strip()
        if name:
            twins = sum(re.fullmatch(re.escape(name) + r"(_\d+)?", x) is not None for x in out.values())
            out[at] = name if not twins else f"{name}_{twins + 1}"
    return out


def excel(spark: SparkSession, paths: list[str], sheet: str, skip: int = 0) -> DataFrame:
    """file and the columns, all text, of the sheet of that name in every workbook; skip: rows above the header. The first workbook's header gives the columns; others must have the same."""

    def start(path):
        fs, at = opened(path)
        book = zipfile.ZipFile(fs.open_input_file(at))
        files = sheet_files(book)
        if sheet not in files:
            raise ValueError(f"{path} has no sheet {sheet}, but {sorted(files)}")
        rows = cells(book, files[sheet])
        for _ in range(skip):
            next(rows, None)
        return header_names(next(rows, {})), rows

    names = list(start(paths[0])[0].values())
    if not names:
        raise ValueError(f"no header in row {skip + 1} of {sheet}")
    schema = pa.schema([("file", pa.string()), *((n, pa.string()) for n in names)])

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                head, rows = start(path)
                if list(head.values()) != names:
                    raise ValueError(f"{path} has the columns {list(head.values())}, not {names}")
                held = []
                for row in rows:
                    own = {n: row.get(at) for at, n in head.items()}
                    if any(v is not None for v in own.values()):
                        held.append({"file": path} | own)
                    if len(held) == BATCH:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    quoted = ", ".join(f"`{n.replace('`', '``')}` string" for n in ["file", *names])
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths), "path").mapInArrow(run, quoted)
