"""Readers and writers: CSV (pandas missing-value tokens), JSON, workbooks, batches.

Reading never infers types by sampling on the driver: text is read as string, the
missing-value tokens become null, and one aggregate pass decides per column whether
every value parses as an integer, a double or a boolean.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from datetime import date, datetime, timedelta
from urllib.parse import unquote
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from facsimile.functions.fmt import to_number
from facsimile.functions.names import free_name, named
from facsimile.session import spread, written

# The text a CSV reader takes as missing (pandas defaults).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
             "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
TIMESTAMP_TEXT = "yyyy-MM-dd HH:mm:ss"


def null_tokens(c: Column) -> Column:
    return F.when(c.isin(*NA_TOKENS), F.lit(None).cast("string")).otherwise(c)


def type_exprs(df: DataFrame, columns: list[str] | None = None) -> list[Column]:
    """Typed projections for text columns, decided in one aggregate pass: all integers
    -> bigint, all numbers -> double, all true/false -> boolean, nothing at all ->
    double (a column of NaN), else string."""
    cols = columns if columns is not None else df.columns
    aggs = []
    for i, c in enumerate(cols):
        x = named(c)
        aggs += [F.count(x).alias(f"n{i}"), F.count(x.try_cast("bigint")).alias(f"l{i}"),
                 F.count(to_number(x)).alias(f"d{i}"),
                 F.count_if(F.lower(x).isin("true", "false")).alias(f"b{i}")]
    r = df.agg(*aggs).first()
    out = []
    for i, c in enumerate(cols):
        n = r[f"n{i}"]
        x = named(c)
        if n == 0:
            out.append(x.try_cast("double").alias(c))
        elif r[f"l{i}"] == n:
            out.append(x.try_cast("bigint").alias(c))
        elif r[f"d{i}"] == n:
            out.append(to_number(x).alias(c))
        elif r[f"b{i}"] == n:
            out.append((F.lower(x) == "true").alias(c))
        else:
            out.append(x)
    return out


def infer_types(df: DataFrame) -> DataFrame:
    return df.select(*type_exprs(df))


FILE = "__file__"       # name of the file a row comes from, beside the files' own columns


def _options(reader, splittable: bool):
    """Header, doubled quotes, and records that may go over several lines unless ``splittable``."""
    return (reader.option("header", True).option("escape", '"').option("inferSchema", False)
            .option("multiLine", not splittable).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))


def _whole_lines(spark: SparkSession, paths) -> None:
    """Raise if a quoted cell goes over a line break: its first line has an odd number of quotes."""
    odd = spark.read.text(paths).agg(F.count_if(F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1)).first()[0]
    if odd:
        raise ValueError(f"{odd} lines begin or end a quoted cell of several lines; read them without splittable=True")


def unique_names(names: list[str | None]) -> list[str]:
    """Stripped header names; an empty one becomes 'Unnamed: i', a repeated one gets '.1', '.2', ..."""
    out: list[str] = []
    for i, n in enumerate(names):
        n = (n or "").strip() or f"Unnamed: {i}"
        k, name = 0, n
        while name in out:
            k += 1
            name = f"{n}.{k}"
        out.append(name)
    return out


def read_csv(spark: SparkSession, paths: str | list[str], infer: bool = True, with_file: bool = False,
             splittable: bool = False) -> DataFrame:
    """CSV with a header row; missing-value tokens to null; optional one-pass typing.

    A quoted cell may hold line breaks, so a file is one task's.  ``splittable`` cuts
    large files into many tasks at line breaks; it first counts lines that only a cell of
    several lines can have and raises an error if there are any.  ``with_file`` adds
    ``source_file`` (the file name) so many files of one layout can be read as one DataFrame and still be told apart.
    """
    if splittable:
        _whole_lines(spark, paths)
    raw = _options(spark.read, splittable).csv(paths)
    extra = [F.col("_metadata.file_name").alias("source_file")] if with_file else []
    names = unique_names([c if not re.fullmatch(r"_c\d+", c) else "" for c in raw.columns])
    df = raw.select(*[null_tokens(named(c)).alias(n) for c, n in zip(raw.columns, names)], *extra)
    if not infer:
        return df
    return df.select(*type_exprs(df, names), *(["source_file"] if with_file else []))


def _header_cells(line: str) -> tuple[str, ...]:
    return tuple(next(csv.reader([line]), []))


def _plain(path: str) -> str:
    """A file's address in one form, as Spark's readers and the file system write it differently."""
    return re.sub("^file:/+", "file:/", path)


def _listed(spark: SparkSession, paths: list[str]) -> tuple[list[str], list[str]]:
    """(files under the paths, paths that are not there); a folder stands for its visible files."""
    here, gone = [], []
    conf = spark._jsc.hadoopConfiguration()
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            gone.append(p)
            continue
        for s in fs.listStatus(path):
            if s.isFile() and s.getPath().getName()[0] not in "._":
                here.append(_plain(s.getPath().toString()))
    return here, gone


def _file_path() -> Column:
    """The file of a row in the form of :func:`_plain`."""
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, "^file:/+", "file:/")


def _raw_layouts(spark: SparkSession, paths: list[str]) -> tuple[list[tuple[list[str], DataFrame]], DataFrame]:
    """([(names, rows as text with FILE)], status): files grouped by their header, malformed ones left out.

    The headers come from one pass over the files' first lines, a row a file; every
    header's files are read together, the columns by their names.
    """
    here, gone = _listed(spark, paths)
    status = spark.createDataFrame([(p.rstrip("/").rsplit("/", 1)[-1], 0, "Error: no such file") for p in gone],
                                   "dataset string, rows long, status string")
    if not here:
        return [], status
    first = (spark.read.text(here).select("value", _file_path().alias("path"), F.col("_metadata.file_block_start").alias("at"))
             .where("at = 0").groupBy("path").agg(F.first("value").alias("header")))      # a file's first block is one task's, in order
    headers = {r["path"]: r["header"] for r in first.collect()}   # one row a file
    known = [(p, headers.get(p)) for p in here]
    layouts: dict[tuple[str, ...], list[str]] = {}
    empty = []
    for path, header in sorted(known, key=lambda r: r[0]):
        cells = _header_cells(header.lstrip("\ufeff")) if header else ()
        if any(c.strip() for c in cells):
            layouts.setdefault(tuple(cells), []).append(path)
        else:
            empty.append(path)
    out, states = [], []
    for cells, own in layouts.items():
        names = unique_names(list(cells))
        # a spare column catches rows with more fields than the header; shorter rows end in nulls
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))] + [T.StructField("extra", T.StringType())])
        raw = (_options(spark.read.schema(schema), False).option("mode", "PERMISSIVE").csv(own)
               .select("*", _file_path().alias("path")))
        states.append(raw.groupBy("path").agg(F.count(F.lit(1)).alias("rows"), F.count("extra").alias("bad")))
        out.append((names, raw))
    listed = spark.createDataFrame([(p,) for own in layouts.values() for p in own], "path string")
    counted = None
    for st in states:
        counted = st if counted is None else counted.unionByName(st)
    if counted is not None:
        # counted once and kept: what is left out below is what the status says
        counted = written(listed.join(counted, "path", "left").select(
            "path", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("bad", F.lit(0)).alias("bad")), "files")
        reason = (F.when(F.col("bad") > 0, F.concat(F.lit("Error: "), F.col("bad").cast("string"), F.lit(" malformed rows")))
                  .when(F.col("rows") == 0, F.lit("Error: no rows")).otherwise(F.lit("Loaded")))
        status = status.unionByName(counted.select(_file_name("path").alias("dataset"), "rows", reason.alias("status")))
        wrong = counted.where((F.col("bad") > 0) | (F.col("rows") == 0)).select(F.col("path").alias("__wrong"))
        out = [(names, raw.join(F.broadcast(wrong) if len(known) <= 20_000 else wrong, F.col("path") == F.col("__wrong"), "left_anti")
                .select(*[null_tokens(F.col(f"c{i}")).alias(n) for i, n in enumerate(names)], _file_name("path").alias(FILE)))
               for names, raw in out]
    if empty:
        status = status.unionByName(spark.createDataFrame([(p.rsplit("/", 1)[-1], 0, "Error: no header") for p in empty],
                                                          "dataset string, rows long, status string"))
    return out, status


def _file_name(path: str) -> Column:
    return F.element_at(F.split(F.col(path), "/"), -1)


def read_csv_layouts(spark: SparkSession, paths: list[str], infer: bool = True) -> tuple[list[DataFrame], DataFrame]:
    """(a DataFrame for each set of column names, status): files that may differ in layout.

    Files whose headers hold the same names, in any order, are one DataFrame, with
    ``FILE`` telling them apart.  The status (dataset, rows, status) has every path
    given: 'Loaded', or the reason why a file is left out: malformed rows, no rows under
    the header, no header, no such file.
    """
    parts, status = _raw_layouts(spark, paths)
    by_names: dict[frozenset, DataFrame] = {}
    for names, rows in parts:
        key = frozenset(names)
        by_names[key] = rows if key not in by_names else by_names[key].unionByName(rows)
    out = list(by_names.values())
    if infer:
        out = [d.select(*type_exprs(d, [c for c in d.columns if c != FILE]), FILE) for d in out]
    return out, status


def read_csv_files(spark: SparkSession, paths: list[str], infer: bool = True) -> tuple[DataFrame, DataFrame]:
    """Many CSV files as one DataFrame with ``dataset`` = file name, plus a status table
    (dataset, rows, status).

    Columns meet by name, whatever their order in a file; a file that lacks one has nulls
    there.  A file with rows that do not fit its header is reported as an error and left
    out, as is one without rows; the others go on (the batch loop's per-file try).  A
    file's own column called ``dataset`` puts an underscore in front of the added one.
    """
    parts, status = _raw_layouts(spark, paths)
    if not parts:
        return spark.createDataFrame([], "dataset string"), status
    good = None
    for _, rows in parts:
        good = rows if good is None else good.unionByName(rows, allowMissingColumns=True)
    names = [c for c in good.columns if c != FILE]
    good = good.select(*(type_exprs(good, names) if infer else [named(c) for c in names]), named(FILE).alias(free_name("dataset", names)))
    return good, status


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    w = (df.write.mode(mode).option("header", True).option("escape", '"')
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .option("timestampNTZFormat", TIMESTAMP_TEXT).option("timestampFormat", TIMESTAMP_TEXT))
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON Lines; nulls are written (pandas writes them too)."""
    (df.write.mode(mode).option("ignoreNullFields", False).option("timestampNTZFormat", TIMESTAMP_TEXT)
     .option("timestampFormat", TIMESTAMP_TEXT).json(path))


def read_json(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.json(path)
    return df.select(*columns) if columns else df


def write_batch(df: DataFrame, path: str, key: str = "dataset") -> None:
    """Every dataset into its own folder ``<key>=<name>`` of one directory tree."""
    write_csv(df, path, partition_by=[key])


def read_batch(spark: SparkSession, path: str, key: str = "dataset") -> DataFrame:
    """Read a tree written by :func:`write_batch`; the partition folder gives ``key``."""
    raw = _options(spark.read, False).csv(path)
    data_cols = [c for c in raw.columns if c != key]
    df = raw.select(named(key).cast("string").alias(key), *[null_tokens(named(c)).alias(c) for c in data_cols])
    return df.select(named(key), *type_exprs(df, data_cols))


# ---------------------------------------------------------------- workbooks (.xlsx)

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    k = 0
    for ch in letters:
        k = k * 26 + (ord(ch) - 64)
    return k - 1


def _first_sheet(z: zipfile.ZipFile) -> str:
    """The part of the sheet that stands first in the workbook, whatever its file is called."""
    names = set(z.namelist())
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
        sheet = ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets/m:sheet", _NS)
        rid = sheet.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id") if sheet is not None else None
        for rel in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")):
            if rel.get("Id") == rid:
                target = rel.get("Target").lstrip("/")
                part = target if target.startswith("xl/") else f"xl/{target}"
                if part in names:
                    return part
    sheets = [n for n in names if re.match(r"xl/worksheets/sheet\d+\.xml$", n)]
    if not sheets:
        raise ValueError("a workbook without a sheet")
    return min(sheets, key=lambda n: int(re.search(r"\d+", n)[0]))


def _date_styles(z: zipfile.ZipFile) -> tuple[set[int], bool]:
    """(cell styles that show a number as a date or time, whether days count from 1904)."""
    base_1904 = False
    if "xl/workbook.xml" in z.namelist():
        pr = ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:workbookPr", _NS)
        base_1904 = pr is not None and pr.get("date1904") in ("1", "true")
    if "xl/styles.xml" not in z.namelist():
        return set(), base_1904
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in root.findall("m:numFmts/m:numFmt", _NS)}

    def dated(k: int) -> bool:
        if k in own:    # quoted text, escapes and colours of a format say nothing
            code = re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", own[k].lower())
            return bool(re.search("[ymdhs]", code)) and "general" not in code
        return 14 <= k <= 22 or 45 <= k <= 47

    return {i for i, x in enumerate(root.findall("m:cellXfs/m:xf", _NS)) if dated(int(x.get("numFmtId") or 0))}, base_1904


def _date_text(value: str, base_1904: bool) -> str:
    """A day number as 'yyyy-MM-dd HH:mm:ss' (day 60 of the 1900 system, 29 February 1900, is no day)."""
    days = float(value)
    start = datetime(1904, 1, 1) if base_1904 else datetime(1899, 12, 30) if days >= 60 else datetime(1899, 12, 31)
    return (start + timedelta(seconds=round(days * 86400))).strftime("%Y-%m-%d %H:%M:%S")


def xlsx_rows(data: bytes) -> Iterator[list[str | None]]:
    """Rows of the first sheet of an .xlsx file as text (stdlib zip + XML only), one after the other.

    Numbers shown as dates become dates; rows and cells that a sheet leaves out are empty.
    """
    z = zipfile.ZipFile(io.BytesIO(data))
    shared: list[str] = []
    if "xl/sharedStrings.xml" in z.namelist():
        root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
        for si in root.findall("m:si", _NS):
            shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
    dates, base_1904 = _date_styles(z)
    last = 0
    with z.open(_first_sheet(z)) as part:
        for _, row in ElementTree.iterparse(part):
            if row.tag != f"{{{_NS['m']}}}row":
                continue
            cells: dict[int, str | None] = {}
            for k, c in enumerate(row.findall("m:c", _NS)):
                v = c.find("m:v", _NS)
                t = c.get("t")
                if t == "inlineStr":
                    is_ = c.find("m:is", _NS)
                    text = "".join(x.text or "" for x in is_.iter(f"{{{_NS['m']}}}t")) if is_ is not None else None
                elif v is None:
                    text = None
                elif t == "s":
                    text = shared[int(v.text)]
                elif t == "b":
                    text = "TRUE" if v.text == "1" else "FALSE"
                elif t in (None, "n") and int(c.get("s") or 0) in dates and v.text:
                    text = _date_text(v.text, base_1904)
                else:
                    text = v.text
                cells[_col_index(c.get("r")) if c.get("r") else k] = text
            at = int(row.get("r") or last + 1)
            for _ in range(at - last - 1):
                yield []
            last = at
            width = max(cells) + 1 if cells else 0
            yield [cells.get(i) for i in range(width)]
            row.clear()


def read_excel(spark: SparkSession, paths: str | list[str], header_row: int = 0, infer: bool = True) -> DataFrame:
    """Workbooks as one DataFrame: each file is parsed in its own task, a row at a time.

    ``header_row`` 0 takes the first row as names; 1 takes the second (names are
    stripped).  Columns meet by name, whatever their order in a workbook; a workbook or
    row that lacks one has nulls there.  Rows without any value are left out.  A column
    whose values all are dates is a timestamp.  Output has ``source_file``.
    """
    return workbook_table(spark.read.format("binaryFile").load(paths).select("path", "content"), header_row, infer)


def workbook_table(files: DataFrame, header_row: int = 0, infer: bool = True) -> DataFrame:
    """The rows of workbooks given as (path, content binary); see :func:`read_excel`.

    Every workbook is parsed once: its cells are written, and header, types and rows come from there.
    """
    schema = pa.schema([("source_file", pa.string()), ("names", pa.list_(pa.string())), ("cells", pa.list_(pa.string()))])

    def parse(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                names, held = None, []
                for k, r in enumerate(xlsx_rows(content.as_py())):
                    if k == header_row:
                        names = unique_names(r)
                        held.append((names, None))
                    elif k > header_row and any(v is not None for v in r):
                        held.append((None, [*r, *[None] * (len(names) - len(r))][:len(names)]))
                    if len(held) >= 1000:
                        yield _cells(schema, path, names, held)
                        held = []
                if held:
                    yield _cells(schema, path, names, held)

    long = written(files.select("path", "content").mapInArrow(
        parse, "source_file string, names array<string>, cells array<string>"), "workbook-cells")
    # the files' own headers: as many names as there are columns
    seen = (long.where("cells is null").select("source_file", F.posexplode("names").alias("at", "name"))
            .groupBy("name").agg(F.min(F.struct("source_file", "at")).alias("first")).orderBy("first").select("name").collect())
    names = [r["name"] for r in seen]
    if not names:
        raise ValueError("no header row found")
    body = long.where("cells is not null").withColumn("m", F.map_from_arrays("names", "cells"))
    file = free_name("source_file", names)
    df = body.select(*[null_tokens(F.try_element_at("m", F.lit(n))).alias(n) for n in names], F.col("source_file").alias(file))
    if not infer:
        return df
    typed = df.select(*type_exprs(df, names), named(file))
    dates = [f.name for f in typed.schema.fields if isinstance(f.dataType, T.StringType) and f.name != file]
    if dates:
        fits = df.agg(*[F.count_if(named(c).isNotNull() & ~named(c).rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$")).alias(f"x{i}")
                        for i, c in enumerate(dates)]).first()
        whole = {c for i, c in enumerate(dates) if fits[f"x{i}"] == 0}
        typed = typed.select(*[named(c).try_cast("timestamp_ntz").alias(c) if c in whole else named(c) for c in typed.columns])
    return typed


_BOOK = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
        '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        '<Default Extension="xml" ContentType="application/xml"/>'
        '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
        '<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>'
        '<Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" '
        'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" '
        'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" '
        'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/></Relationships>',
    "xl/workbook.xml": '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" '
        'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="data" sheetId="1" r:id="rId1"/></sheets></workbook>',
    "xl/styles.xml": '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>',
}


def _book(names: list[str], rows: list[tuple]) -> bytes:
    """One .xlsx file: a header and typed cells; dates and times as day numbers."""
    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (datetime, date)):
            at = v if isinstance(v, datetime) else datetime(v.year, v.month, v.day)
            return f'<c s="1"><v>{(at.replace(tzinfo=None) - datetime(1899, 12, 30)) / timedelta(days=1)!r}</v></c>'
        if isinstance(v, (int, float)) and v == v and abs(v) != float("inf"):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    body = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in [tuple(names), *rows])
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in _BOOK.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
        z.writestr("xl/worksheets/sheet1.xml", '<?xml version="1.0" encoding="UTF-8"?><worksheet '
                   f'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')
    return buf.getvalue()


SHEET_ROWS = 1_048_575      # fixed value: rows a sheet can hold beside its header


def workbooks(df: DataFrame, rows_per_book: int = 100_000) -> DataFrame:
    """(path, content): the table as .xlsx files of at most so many rows.

    A sheet has a row limit and is built in memory, so every task cuts its rows into books.
    The rows of a few partitions are dealt to more tasks first, as many as there are books at most.
    """
    limit = min(rows_per_book, SHEET_ROWS)
    df = spread(df, limit)
    names = df.columns
    schema = pa.schema([("path", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held = TaskContext.get().partitionId(), 0, []

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(path=f"book-{part:05d}-{k:05d}.xlsx", content=_book(names, held[:limit]))], schema)

        for b in batches:
            held += list(zip(*(c.to_pylist() for c in b.columns)))
            while len(held) >= limit:
                yield close()
                k, held = k + 1, held[limit:]
        if held:
            yield close()

    return df.mapInArrow(run, "path string, content binary")


def _cells(schema: pa.Schema, path: str, names: list[str], held: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(source_file=unquote(path.rsplit("/", 1)[-1]), names=names, cells=c) for _, c in held], schema)


def load_table(spark: SparkSession, path: str, **kw) -> DataFrame:
    """Dispatch on the extension: workbook, JSON, else CSV."""
    low = path.lower()
    if low.endswith((".xlsx", ".xls")):
        if low.endswith(".xls"):
            raise ValueError("legacy .xls workbooks are not supported; save as .xlsx")
        return read_excel(spark, path, **kw)
    if low.endswith(".json"):
        return read_json(spark, path)
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    return read_csv(spark, path, **kw)
