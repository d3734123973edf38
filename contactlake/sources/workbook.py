"""xlsx workbooks as a distributed source and sink (standard library only).

Reading: ``binaryFile`` lists the files (length checked before any content
is parsed); ``mapInPandas`` turns each file into rows ``(path, sheets,
row_idx, cells)`` -- one task per file, bounded by the file-size limit.
Only the header rows reach the driver (one small row per file) to resolve
column names; the data rows stay distributed and are projected with
``getItem``. Files that share a header share one projection.

Writing: rows are range-partitioned by ``S.N.`` and every partition writes
workbook parts (sheet ``Truth Data``) with inline strings, one after another.
The number of partitions follows the rows, not the parts: a shuffle has a
block for each pair of tasks, and parts may be small.
"""

from __future__ import annotations

import functools
import io
import re
import zipfile
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..session import checkpoint_dir, posix_path, ship_package

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main",
       "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
_REL_NS = "http://schemas.openxmlformats.org/package/2006/relationships"

# --------------------------------------------------------------------------
# Cell texts read as missing (the pandas default NA tokens).
# --------------------------------------------------------------------------
NA_TOKENS = {"", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"}
MAX_SHEET_ROWS = 1_048_576
#: Rows of a task that writes workbooks, where there are more parts than tasks can run at once.
ROWS_A_TASK = 50_000
# --------------------------------------------------------------------------

_CELL_REF = re.compile(r"^([A-Z]+)(\d+)$")
# a path with its namespace is looked up without a parse of the path for each cell
_ROW, _CELL, _VALUE, _INLINE, _TEXT = (f"{{{_NS['m']}}}{t}" for t in ("row", "c", "v", "is", "t"))


def _col_index(ref: str) -> int:
    return _letters_index(_CELL_REF.match(ref).group(1))


@functools.lru_cache(1 << 15)
def _letters_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _text_of(el) -> str:
    return "".join(t.text or "" for t in el.iter(_TEXT))


def parse_xlsx(data: bytes) -> tuple[int, list[list[str | None]]]:
    """(number of sheets, rows of the first sheet as text cells, None for
    blank or NA cells). Shared and inline strings, numbers and booleans."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        wb = ET.fromstring(z.read("xl/workbook.xml"))
        sheets = wb.findall("m:sheets/m:sheet", _NS)
        rid = sheets[0].get(f"{{{_NS['r']}}}id")
        rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        target = next(r.get("Target") for r in rels if r.get("Id") == rid)
        target = target.lstrip("/")
        path = target if target.startswith("xl/") else "xl/" + target
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            sst = ET.fromstring(z.read("xl/sharedStrings.xml"))
            shared = [_text_of(si) for si in sst.findall("m:si", _NS)]
        sheet = ET.fromstring(z.read(path))
    rows: list[list[str | None]] = []
    for row in sheet.iter(_ROW):
        r_idx = int(row.get("r")) - 1 if row.get("r") else len(rows)
        while len(rows) < r_idx:
            rows.append([])
        cells: list[str | None] = []
        for pos, c in enumerate(row.findall(_CELL)):
            ref = c.get("r")
            idx = _col_index(ref) if ref else pos
            t = c.get("t")
            v = c.find(_VALUE)
            if t == "inlineStr":
                inline = c.find(_INLINE)
                val = None if inline is None else _text_of(inline)
            elif v is None:
                val = None
            elif t == "s":
                val = shared[int(v.text)]
            elif t == "b":
                val = "True" if v.text == "1" else "False"
            else:
                val = v.text
            while len(cells) < idx:
                cells.append(None)
            cells.append(None if val is None or val in NA_TOKENS else val)
        rows.append(cells)
    return len(sheets), rows


def header_names(cells: list[str | None]) -> list[str]:
    """Header row -> names: blank -> ``Unnamed: i``; repeats -> ``name.1``..."""
    names, seen = [], {}
    for i, h in enumerate(cells):
        name = f"Unnamed: {i}" if h is None or str(h).strip() == "" else str(h)
        if name in seen:
            seen[name] += 1
            cand = f"{name}.{seen[name]}"
            while cand in seen:
                seen[name] += 1
                cand = f"{name}.{seen[name]}"
            seen[cand] = 0
            name = cand
        else:
            seen[name] = 0
        names.append(name)
    return names


def _parse_files(it):
    import pandas as pd

    for pdf in it:
        out_path, out_sheets, out_idx, out_cells = [], [], [], []
        for path, content in zip(pdf["path"].tolist(), pdf["content"].tolist()):
            n_sheets, rows = parse_xlsx(content)
            for i, cells in enumerate(rows):
                out_path.append(path)
                out_sheets.append(n_sheets)
                out_idx.append(i)
                out_cells.append(cells)
            if not rows:
                out_path.append(path)
                out_sheets.append(n_sheets)
                out_idx.append(0)
                out_cells.append([])
        yield pd.DataFrame({"path": out_path, "sheets": out_sheets, "row_idx": out_idx, "cells": out_cells})


class WorkbookRead:
    """Result of :func:`read_workbooks`: ``frame`` (all-text columns plus
    ``_file`` and ``_row_id`` in file-then-row order) and ``warnings``."""

    def __init__(self, frame: DataFrame, warnings: list[str]) -> None:
        self.frame = frame
        self.warnings = warnings


def read_workbooks(spark: SparkSession, path: str, max_file_mb: float | None = None,
                   max_rows: int = 0) -> WorkbookRead:
    """Read the first sheet of every ``*.xlsx`` under ``path``.

    Raises ``ValueError`` for a file over ``max_file_mb`` (if given; checked on
    the listed length, before parsing) or a sheet over ``max_rows`` data rows
    (0 = unlimited).
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    too_big = [] if max_file_mb is None else files.where(F.col("length") > F.lit(int(max_file_mb * 1024 * 1024))).select(
        "path", "length").limit(1).collect()
    if too_big:
        mb = too_big[0]["length"] / (1024 * 1024)
        raise ValueError(f"File too large: {mb:.1f}MB (max: {max_file_mb}MB)")
    ship_package(spark)
    parsed = files.select("path", "content").mapInPandas(
        _parse_files, "path string, sheets int, row_idx long, cells array<string>")
    checkpoint_dir(spark)
    parsed = parsed.checkpoint(eager=True)
    heads = parsed.where(F.col("row_idx") == 0).select("path", "sheets", "cells").collect()
    warnings: list[str] = []
    if any(h["sheets"] > 1 for h in heads):
        warnings.append(S.MSG_MULTIPLE_SHEETS)
    data = parsed.where(F.col("row_idx") > 0)
    files_ = data.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("row_idx").alias("last"),
                                      F.max(F.size("cells")).alias("width")).collect()
    over = [r["last"] for r in files_ if max_rows and r["last"] > max_rows]
    if over:
        raise ValueError(f"File has {over[0]} rows (max: {max_rows}).")
    width = max((r["width"] for r in files_), default=0)
    groups: dict[tuple, list[str]] = {}
    for h in heads:
        cells = list(h["cells"] or [])
        cells = cells + [None] * max(0, width - len(cells))
        groups.setdefault(tuple(header_names(cells)), []).append(h["path"])
    frames = []
    for names, paths in groups.items():
        if any(re.match(r"^.+\.\d+$", n.strip()) for n in names):
            warnings.append(S.MSG_DUPLICATE_COLUMNS)
        rows = data if len(groups) == 1 else data.where(F.col("path").isin(paths))
        part = rows.select(
            F.col("path").alias("_file"), "row_idx",
            *[F.get(F.col("cells"), i).alias(n) for i, n in enumerate(names)])
        frames.append(part)
    if not frames:
        return WorkbookRead(spark.createDataFrame([], "_file string, _row_id long"), warnings)
    frame = frames[0]
    for f in frames[1:]:
        frame = frame.unionByName(f, allowMissingColumns=True)
    # position = rows of earlier files + row index inside the file (rows of a
    # file are numbered contiguously by the parser): one count per file
    offsets, running = [], 0
    for r in sorted(files_, key=lambda r: r["path"]):
        offsets.append((r["path"], running))
        running += int(r["n"])
    off = spark.createDataFrame(offsets or [("", 0)], "_file string, __off long")
    frame = frame.join(F.broadcast(off), "_file", "inner") \
        .withColumn("_row_id", F.col("__off") + F.col("row_idx") - 1).drop("row_idx", "__off")
    return WorkbookRead(frame, sorted(set(warnings), key=warnings.index))


# ---------------------------------------------------------------- writing

@functools.lru_cache(1 << 15)
def _col_letter(i: int) -> str:
    s = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        s = chr(65 + r) + s
    return s


def build_xlsx(header: list[str], rows, sheet_name: str = S.EXPORT_SHEET) -> bytes:
    """Minimal single-sheet workbook with inline strings and numbers as text."""
    buf = io.StringIO()
    buf.write('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
              f'<worksheet xmlns="{_NS["m"]}"><sheetData>')

    def row_xml(r_num: int, values) -> None:
        buf.write(f'<row r="{r_num}">')
        for i, v in enumerate(values):
            if v is None:
                continue
            ref = f"{_col_letter(i)}{r_num}"
            buf.write(f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>')
        buf.write("</row>")

    row_xml(1, header)
    n = 1
    for values in rows:
        n += 1
        if n > MAX_SHEET_ROWS:
            raise ValueError("more rows than one sheet holds; use more partitions")
        row_xml(n, values)
    buf.write("</sheetData></worksheet>")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml",
                   '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
                   '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
                   '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
                   '<Default Extension="xml" ContentType="application/xml"/>'
                   '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
                   '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'
                   '</Types>')
        z.writestr("_rels/.rels",
                   f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="{_REL_NS}">'
                   '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/>'
                   '</Relationships>')
        z.writestr("xl/workbook.xml",
                   f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><workbook xmlns="{_NS["m"]}" '
                   f'xmlns:r="{_NS["r"]}"><sheets><sheet name="{escape(sheet_name)}" sheetId="1" r:id="rId1"/>'
                   '</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels",
                   f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="{_REL_NS}">'
                   '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/>'
                   '</Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", buf.getvalue())
    return out.getvalue()


def export_workbooks(df: DataFrame, out_dir: str, rows_per_part: int = 500_000,
                     order_col: str = S.SN, sheet_name: str = S.EXPORT_SHEET) -> list[str]:
    """Write ``df`` as workbook parts ``part-00000-00000.xlsx`` ... in
    ``order_col`` order: range partitions, each of one part or more, of
    ``rows_per_part`` rows at most and one sheet. ``out_dir`` must be a
    folder every executor can write (shared mount). Raises ``ValueError``
    ("No data to export") on an empty frame. Returns the part paths."""
    import os

    ship_package(df.sparkSession)
    checkpoint_dir(df.sparkSession)
    df = df.checkpoint(eager=True)  # counted, sampled for its ranges and written
    n = df.count()
    if not n:
        raise ValueError(S.MSG_NO_DATA_EXPORT)
    parts = max(1, -(-n // rows_per_part))
    tasks = min(parts, max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS_A_TASK)))
    header = df.columns
    out_dir = posix_path(out_dir)
    ordered = df.repartitionByRange(tasks, F.col("`" + order_col + "`")).sortWithinPartitions(
        F.col("`" + order_col + "`"))

    def write(it):
        import pandas as pd
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        held, done = [], 0

        def part(rows):
            path = os.path.join(out_dir, f"part-{pid:05d}-{done:05d}.xlsx")
            os.makedirs(out_dir, exist_ok=True)
            with open(path + ".tmp", "wb") as fh:
                fh.write(build_xlsx(header, rows, sheet_name))
            os.replace(path + ".tmp", path)
            return pd.DataFrame({"path": [path], "rows": [len(rows)]})

        for pdf in it:
            held.extend(pdf.astype(object).where(pdf.notna(), None).values.tolist())
            while len(held) > rows_per_part:
                yield part(held[:rows_per_part])
                held, done = held[rows_per_part:], done + 1
        if held:
            yield part(held)

    # positional names: mapInPandas resolves columns by name, and names such
    # as "S.N." are not valid attribute names there
    written = ordered.select(*[F.col("`" + c + "`").cast("string").alias(f"c{i}") for i, c in enumerate(header)]) \
        .mapInPandas(write, "path string, rows long").collect()
    return sorted(r["path"] for r in written)


def export_file_name(prefix: str = "contacts_export") -> str:
    """``<prefix>_YYYYMMDD_HHMMSS.xlsx`` in UTC."""
    from datetime import datetime, timezone

    return f"{prefix}_{datetime.now(timezone.utc).strftime('%Y%m%d_%H%M%S')}.xlsx"
