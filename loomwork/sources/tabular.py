"""Tables from files and in-line records: formats, separators, null tokens, inferred types.

The driver looks at the first bytes only; the data stays on the executors.
"""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from urllib.parse import urlparse
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.operators.profile import merge_label, schema_warnings, union_relaxed
from loomwork.sources import csv_ranges, hosted

# Formats by extension, separators in order of preference, null tokens, signs of a web page (or a drive's
# warning in place of a file), where a drive gives files.
FORMATS = {"csv": "csv", "json": "json", "jsonl": "json", "ndjson": "json", "parquet": "parquet", "xlsx": "xlsx", "xls": "xls"}
SEPARATORS = [",", ";", "\t", "|"]
NULLS = ["", "null", "NULL", "None", "NA", "N/A", "n/a", "-"]
HTML_SIGNS = ["<!doctype html", "<html", "<head", "virus scan warning", "google drive"]
DRIVE_HOST = "drive.google.com"
DRIVE_DOWNLOAD = "https://drive.usercontent.google.com/download?id={id}&export=download&confirm=t"
ZIP_ORDER = ["csv", "json", "parquet", "xlsx", "xls"]
ZIP_MAGIC = b"PK\x03\x04"

INFER_ROWS = 10_000
MOST_FILES = 20


class SourceError(ValueError):
    """A source that cannot be read as it is."""


#: From a location to bytes; the caller opens connections, nothing here does.
Fetch = Callable[[str], bytes]
#: How the location of a hosted dataset begins; the rest is its id.
HOSTED = "dataset:"


@dataclass(frozen=True)
class Source:
    """Where a table comes from: a path, an address, the id of a hosted dataset, or in-line records."""

    location: str = ""
    inline: object = None
    table_name: str | None = None

    @property
    def format(self) -> str:
        return "inline" if self.inline is not None else format_of(self.location)


def format_of(location: str) -> str:
    """By the extension of the path; anything unknown is CSV."""
    ext = os.path.splitext(urlparse(location).path)[1].lstrip(".").lower()
    return FORMATS.get(ext, "csv")


def sources_of(config: dict) -> list[Source]:
    """Sources named by a request, in order: in-line data, urls, uploaded files, hosted datasets; a single url only if there is none else.

    An object whose first value is a list has one table for each key; another
    object is one row. Hosted datasets are named by a host's key (anything that
    ends in DatasetId), then by ``datasetId``, then by the resource's default.
    """
    out: list[Source] = []
    data = config.get("inputData")
    if isinstance(data, dict) and data and isinstance(next(iter(data.values())), list):
        out += [Source(inline=v, table_name=k) for k, v in data.items()]
    elif isinstance(data, dict) and data:
        out.append(Source(inline=[data]))
    elif data:
        out.append(Source(inline=data))
    for u in config.get("datasetUrls") or []:
        out.append(Source(u["url"], table_name=u.get("name")) if isinstance(u, dict) else Source(u))
    out += [Source(u) for u in config.get("uploadedFiles") or []]
    resource = config.get("resource") if isinstance(config.get("resource"), dict) else {}
    own = [v for k, v in config.items() if k.endswith("DatasetId")]
    out += [Source(f"{HOSTED}{i}") for i in [*own, config.get("datasetId"), resource.get("defaultDatasetId")] if i]
    if not out and config.get("datasetUrl"):
        out.append(Source(config["datasetUrl"]))
    return out


def direct_download(url: str) -> str:
    """The download form of a link to a shared file on a drive; other links as they are."""
    if DRIVE_HOST not in url:
        return url
    found = re.search(r"[?&]id=([\w-]+)", url, re.A) or re.search(r"/file/d/([\w-]+)", url, re.A)
    if found:
        return DRIVE_DOWNLOAD.format(id=found[1])
    return url + ("&" if "?" in url else "?") + "confirm=t"


def looks_like_html(head: bytes) -> bool:
    low = head[:500].decode("utf-8", "replace").lower()
    return any(s in low for s in HTML_SIGNS)


def zip_member(content: bytes) -> tuple[str, bytes] | None:
    """(name, bytes) of the member to read; None if it is no archive or is itself a workbook."""
    if not content.startswith(ZIP_MAGIC):
        return None
    if not zipfile.is_zipfile(io.BytesIO(content)):
        return None
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = [n for n in z.namelist() if not n.endswith("/") and not n.startswith("__MACOSX")]
        if "xl/workbook.xml" in names:
            return None
        if not names:
            raise SourceError("the archive is empty")
        rank = lambda n: (ZIP_ORDER.index(e) if (e := n.rsplit(".", 1)[-1].lower()) in ZIP_ORDER else len(ZIP_ORDER), names.index(n))
        best = min(names, key=rank)
        return best, z.read(best)


def sniff_separator(text: str) -> str:
    """The most frequent separator in the first 2000 characters, the earlier one of equals."""
    head = text[:2000]
    return max(SEPARATORS, key=lambda s: (head.count(s), -SEPARATORS.index(s)))


def _head(spark: SparkSession, path: str, n: int = 65_536) -> bytes:
    """The first bytes of a file, or of the first file in a folder, by Spark's file systems."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(p).isDirectory():
        files = sorted((s.getPath().toString() for s in fs.listStatus(p) if not s.getPath().getName().startswith(("_", "."))))
        if not files:
            raise SourceError(f"nothing in {path}")
        p = jvm.org.apache.hadoop.fs.Path(files[0])
    stream = fs.open(p)
    try:
        return bytes(stream.readNBytes(n))
    finally:
        stream.close()


_CANDIDATES = ["bigint", "double", "boolean", "date", "timestamp"]


def infer_types(df: DataFrame, rows: int = INFER_ROWS) -> T.StructType:
    """For columns of text: the first type that all values of the first rows have, else text. One pass."""
    part = df.limit(rows)
    fits = []
    for c in df.columns:
        x = F.col(f"`{c}`")
        for kind in _CANDIDATES:
            bad = x.isNotNull() & x.try_cast(kind).isNull()
            if kind == "boolean":
                bad = x.isNotNull() & ~F.lower(x).isin("true", "false")
            if kind in ("date", "timestamp"):
                bad = bad | (x.isNotNull() & ~F.regexp_like(x, F.lit(r"^\d{4}-\d\d?-\d\d?" + ("$" if kind == "date" else ""))))
            fits.append((F.count_if(bad) == 0) & (F.count(x) > 0))
    found = part.agg(*[f.alias(f"f{i}") for i, f in enumerate(fits)]).first()
    kinds = [next((k for j, k in enumerate(_CANDIDATES) if found[i * len(_CANDIDATES) + j]), "string") for i in range(len(df.columns))]
    return T.StructType([T.StructField(c, T._parse_datatype_string(k)) for c, k in zip(df.columns, kinds)])


def read_csv(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """UTF-8, else Latin-1; null tokens; types from the first rows, and a later value that does not fit is an error.

    Files are read in ranges of lines, also where values hold line ends inside their quotes (csv_ranges).
    """
    raw = _head(spark, path)
    if looks_like_html(raw):
        raise SourceError("the file is a web page, not a table")
    charset = "UTF-8"
    try:
        raw[: raw.rfind(b"\n") + 1 or len(raw)].decode("utf-8")
    except UnicodeDecodeError:
        charset = "ISO-8859-1"
    text = raw.decode("utf-8" if charset == "UTF-8" else "latin-1", "replace").lstrip("﻿")
    separator = separator or sniff_separator(text)
    options = {"header": True, "sep": separator, "encoding": charset, "mode": "FAILFAST", "escape": '"', "nullValue": ""}
    records = csv_ranges.records(spark, path, charset, separator, "\n" if "\n" in text else "\r")
    if records is None:
        df = spark.read.options(**options).csv(path)
    else:  # a schema of text takes the first record only
        df = csv_ranges.parsed(records, spark.read.options(multiLine=True, **options).csv(path).columns, separator)
    cleaned = df.select(*[F.when(F.col(f"`{c}`").isin(NULLS), None).otherwise(F.col(f"`{c}`")).alias(c) for c in df.columns])
    schema = infer_types(cleaned)
    return cleaned.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects if the file starts with a bracket, else an object a line."""
    array = _head(spark, path, 4096).lstrip(b"\xef\xbb\xbf \t\r\n").startswith(b"[")
    return spark.read.option("multiLine", array).option("mode", "FAILFAST").json(path)


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PACK = "{http://schemas.openxmlformats.org/package/2006/relationships}"
#: Formats of numbers that every workbook knows as dates or times.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}


def _first_sheet(z: zipfile.ZipFile) -> str:
    """The part of the sheet that the workbook lists first."""
    book, names = ElementTree.fromstring(z.read("xl/workbook.xml")), z.namelist()
    sheet = next(book.iter(f"{_MAIN}sheet"), None)
    if sheet is not None and "xl/_rels/workbook.xml.rels" in names:
        for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(f"{_PACK}Relationship"):
            if r.get("Id") == sheet.get(f"{_REL}id"):
                target = r.get("Target", "")
                return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    found = [n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)]
    return min(found, key=lambda n: int(re.search(r"\d+", n)[0]))


def _date_styles(z: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show dates or times."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId", 0)): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")) for f in root.iter(f"{_MAIN}numFmt")}
    dates = DATE_FORMATS | {k for k, code in own.items() if re.search(r"[dmyhs]", code, re.I) and not re.search(r"general", code, re.I)}
    cells = root.find(f"{_MAIN}cellXfs")
    return {k for k, x in enumerate(cells if cells is not None else []) if int(x.get("numFmtId", 0)) in dates}


def _cells(content: bytes) -> list[list]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names, dates = z.namelist(), _date_styles(z)
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]
        old = next((p.get("date1904") in ("1", "true") for p in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_MAIN}workbookPr")), False)
        epoch = datetime(1904, 1, 1) if old else datetime(1899, 12, 30)

        def value(kind: str | None, style: int, text: str) -> object:
            if kind == "s":
                return shared[int(text)]
            if kind == "b":
                return text == "1"
            if kind == "e":  # an error stands where a value would
                return None
            if kind == "d":
                return datetime.fromisoformat(text)
            if kind == "str":
                return text
            return epoch + timedelta(seconds=round(float(text) * 86_400)) if style in dates else float(text)

        rows = []
        for row in ElementTree.fromstring(z.read(_first_sheet(z))).iter(f"{_MAIN}row"):
            out: dict[int, object] = {}
            for k, c in enumerate(row.iter(f"{_MAIN}c")):
                letters = re.match(r"[A-Z]+", c.get("r", ""))
                col = k if not letters else sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1
                v, kind = c.find(f"{_MAIN}v"), c.get("t")
                if kind == "inlineStr":
                    out[col] = "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                elif v is not None and v.text is not None:
                    out[col] = value(kind, int(c.get("s", 0)), v.text)
            rows.append([out.get(i) for i in range(max(out, default=-1) + 1)])
        return rows


def read_excel(spark: SparkSession, content: bytes) -> DataFrame:
    """The first sheet of an .xlsx workbook: header row, then rows. Workbooks fit in the driver by their format's limits."""
    rows = _cells(content)
    if not rows:
        raise SourceError("the sheet is empty")
    header = [str(h) if h is not None else f"column_{i + 1}" for i, h in enumerate(rows[0])]
    body = [(r + [None] * len(header))[: len(header)] for r in rows[1:]]
    kinds, columns = [], []
    for k in range(len(header)):
        values = [r[k] for r in body]
        seen = {type(v) for v in values if v is not None}
        if seen == {float}:
            whole = all(v is None or v == int(v) for v in values)
            kinds.append("bigint" if whole else "double")
            columns.append([None if v is None else int(v) if whole else v for v in values])
        elif seen == {bool}:
            kinds.append("boolean")
            columns.append(values)
        elif seen == {datetime}:
            days = all(v is None or v.time() == datetime.min.time() for v in values)
            kinds.append("date" if days else "timestamp_ntz")
            columns.append([v.date() if v is not None and days else v for v in values])
        else:
            kinds.append("string")
            columns.append([None if v is None else str(v) for v in values])
    schema = T.StructType([T.StructField(h, T._parse_datatype_string(k)) for h, k in zip(header, kinds)])
    return spark.createDataFrame(list(zip(*columns)) if body else [], schema)


def read_inline(spark: SparkSession, data: object) -> DataFrame:
    """Records given as such: a list of objects, one object, or an object of lists (its first table)."""
    if isinstance(data, dict) and data and isinstance(next(iter(data.values())), list):
        data = next(iter(data.values()))
    rows = [data] if isinstance(data, dict) else list(data or [])
    if not rows:
        raise SourceError("no records")
    names = list(dict.fromkeys(k for r in rows for k in r))
    import json

    lines = [json.dumps({n: r.get(n) for n in names}, default=str) for r in rows]
    df = spark.read.json(spark.sparkContext.parallelize(lines, 1))
    have = set(df.columns)
    return df.select(*[(F.col(f"`{n}`") if n in have else F.lit(None).cast("string")).alias(n) for n in names])


def _bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def _hosted(spark: SparkSession, source: Source, fetch: Fetch | None) -> DataFrame:
    """A hosted dataset's items, in pages that the executors fetch."""
    if fetch is None:
        raise SourceError(f"{source.location} needs a fetcher")
    rows = hosted.read_items(spark, source.location, fetch)
    if rows is None:
        raise SourceError(f"{source.location} is empty")
    return rows


def _fetched(spark: SparkSession, source: Source, fetch: Fetch | None) -> DataFrame:
    """What an address gives, fetched by a task and read from the shared folder; the driver sees the first bytes, and workbooks."""
    if fetch is None:
        raise SourceError(f"{source.location} needs a fetcher")
    content = hosted.content_of(spark, direct_download(source.location), fetch)
    head = lambda df: bytes(df.select(F.substring("content", 1, 65_536).alias("c")).first()["c"])
    begin = head(content)
    if looks_like_html(begin):
        raise SourceError("a web page came in place of a file; ask for a direct link")
    name = os.path.basename(urlparse(source.location).path) or "table"
    if begin.startswith(ZIP_MAGIC):
        member = hosted.unpacked(content, zip_member)
        inner = member.select("name").first()
        if inner is None:  # a workbook
            return read_excel(spark, bytes(content.first()["content"]))
        name, content = inner["name"], member.select("content")
        if format_of(name) == "xlsx":
            return read_excel(spark, bytes(content.first()["content"]))
    if head(content).startswith(b"PAR1"):
        return hosted.parquet_rows(content)
    kind = format_of(name)
    path = hosted.as_text_file(content, f"{uuid.uuid4().hex}.{kind}")
    return read_json(spark, path) if kind == "json" else read_csv(spark, path)


def _of_content(spark: SparkSession, name: str, content: bytes) -> DataFrame:
    from loomwork.runtime import shared_dir

    if inner := zip_member(content):
        name, content = inner
    kind = "xlsx" if content.startswith(ZIP_MAGIC) and zipfile.is_zipfile(io.BytesIO(content)) else format_of(name)
    if kind == "xlsx":
        return read_excel(spark, content)
    return read(spark, Source(_stage(spark, shared_dir(spark), os.path.splitext(os.path.basename(name))[0] + f".{kind}", content)))


def read(spark: SparkSession, source: Source, fetch: Fetch | None = None) -> DataFrame:
    """``fetch`` is asked for web addresses and hosted datasets; paths are Spark's."""
    if source.inline is not None:
        return read_inline(spark, source.inline)
    kind, path = source.format, source.location
    if path.startswith(HOSTED):
        return _hosted(spark, source, fetch)
    if re.match(r"https?://", path):
        return _fetched(spark, source, fetch)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "xls":
        raise SourceError(".xls workbooks are not supported; save as .xlsx")
    if kind == "xlsx":
        return read_excel(spark, _bytes(spark, path))
    if _head(spark, path, 4) == ZIP_MAGIC and zipfile.is_zipfile(io.BytesIO(content := _bytes(spark, path))):
        return _of_content(spark, path, content)
    return read_json(spark, path) if kind == "json" else read_csv(spark, path)


def _stage(spark: SparkSession, base: str, name: str, body: bytes) -> str:
    """Put the driver's bytes where executors can read them."""
    jvm = spark.sparkContext._jvm
    path = f"{base}/staged-{uuid.uuid4().hex}/{name}"
    with tempfile.NamedTemporaryFile(suffix="." + name.rsplit(".", 1)[-1]) as f:
        f.write(body)
        f.flush()
        to = jvm.org.apache.hadoop.fs.Path(path)
        to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).copyFromLocalFile(jvm.org.apache.hadoop.fs.Path("file://" + f.name), to)
    return path


@dataclass
class Loaded:
    df: DataFrame
    warnings: list[str] = field(default_factory=list)
    merge: str = "single_source"


def load(spark: SparkSession, sources: list[Source], fetch: Fetch | None = None) -> Loaded:
    """All sources as one table, united by name."""
    if not sources:
        raise SourceError("no source")
    if len(sources) > MOST_FILES:
        raise SourceError(f"{len(sources)} files; at most {MOST_FILES}")
    frames = [read(spark, s, fetch) for s in sources]
    return Loaded(union_relaxed(frames) if len(frames) > 1 else frames[0], schema_warnings(frames), merge_label(len(frames), False))


def load_named(spark: SparkSession, sources: list[Source], fetch: Fetch | None = None) -> dict[str, DataFrame]:
    """Tables by name: the given one, else the file's, else table_i; equal names get _2, _3 and so on."""
    out: dict[str, DataFrame] = {}
    for i, s in enumerate(sources, 1):
        stem = os.path.splitext(os.path.basename(urlparse(s.location).path))[0]
        name = base = s.table_name or stem or f"table_{i}"
        k = 2
        while name in out:
            name, k = f"{base}_{k}", k + 1
        out[name] = read(spark, s, fetch)
    return out


def view_names(tables: dict[str, DataFrame]) -> dict[str, str]:
    return {name: "df_" + re.sub(r"[-\s]", "_", name) for name in tables}


def register(tables: dict[str, DataFrame]) -> dict[str, str]:
    """Temporary views df_<name> (and df for the first); returns view by table."""
    views = view_names(tables)
    for i, (name, view) in enumerate(views.items()):
        tables[name].createOrReplaceTempView(view)
        if not i:
            tables[name].createOrReplaceTempView("df")
    return views
