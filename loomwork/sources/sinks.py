"""Results as files and payloads."""

from __future__ import annotations

import io
import json
import time
import zipfile
from dataclasses import dataclass, field
from datetime import datetime, timezone
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Media types by format.
MEDIA = {
    "csv": "text/csv",
    "json": "application/json",
    "parquet": "application/vnd.apache.parquet",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}
PREVIEW = 10
INLINE_BYTES = 10 * 2**20
WORKBOOK_ROWS = 1_048_575


def file_name(fmt: str) -> str:
    return f"transformed_data.{fmt}"


def write_csv(df: DataFrame, path: str) -> None:
    """Values with separators, quotes or line ends are quoted, quotes doubled, blanks kept."""
    df.write.options(header=True, nullValue="", emptyValue='""', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """An object a line, nulls kept."""
    df.write.option("ignoreNullFields", False).json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.option("compression", "zstd").parquet(path)


def write_counted(df: DataFrame, path: str, fmt: str = "parquet") -> int:
    """Writes and returns the number of rows, from the same job."""
    from pyspark.sql import Observation

    seen = Observation()
    watched = df.observe(seen, F.count(F.lit(1)).alias("n"))
    {"csv": write_csv, "json": write_json, "parquet": write_parquet}[fmt](watched, path)
    return int(seen.get["n"])


def export(df: DataFrame, path: str, fmt: str) -> int:
    """Any format by its name; returns the number of rows. A workbook is one file, the others are folders."""
    if fmt == "xlsx":
        jvm = df.sparkSession.sparkContext._jvm
        to = jvm.org.apache.hadoop.fs.Path(path)
        out = to.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).create(to)
        try:
            out.write(workbook(df))
        finally:
            out.close()
        return df.count()
    if fmt not in MEDIA:
        raise ValueError(f"unknown format {fmt}; one of {', '.join(MEDIA)}")
    return write_counted(df, path, fmt)


def json_size(df: DataFrame) -> int:
    return int(df.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})) + 1), F.lit(0))).first()[0]) + 1


def inline_rows(df: DataFrame, most: int = INLINE_BYTES) -> list[dict] | None:
    """All rows, if their JSON is within the limit, checked before they are fetched; else None."""
    if json_size(df) > most:
        return None
    return [json.loads(r[0]) for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]


def json_array(df: DataFrame, most: int = INLINE_BYTES) -> str:
    rows = inline_rows(df, most)
    if rows is None:
        raise ValueError(f"over {most} bytes; write it as files")
    return json.dumps(rows, ensure_ascii=False, default=str)


def preview(df: DataFrame, n: int | None = PREVIEW, order_by: str | None = None) -> list[dict]:
    """The first rows: by ``order_by``, else in the frame's own order, which a sorted one has."""
    rows = df if order_by is None else df.orderBy(order_by)
    return [r.asDict(recursive=True) for r in rows.limit(n or PREVIEW).collect()]


@dataclass
class Report:
    """What a transformation came to."""

    status: str
    sources: int = 0
    rows_in: int = 0
    columns_in: list[str] = field(default_factory=list)
    rows_out: int = 0
    columns_out: list[str] = field(default_factory=list)
    file: str | None = None
    format: str = "csv"
    preview: list[dict] = field(default_factory=list)
    milliseconds: int = 0
    code: str | None = None
    generation: dict | None = None
    warnings: list[str] = field(default_factory=list)
    errors: list[dict] = field(default_factory=list)
    data: list[dict] | None = None
    at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))

    def to_dict(self) -> dict:
        """Under the names that callers read; all rows only where they are few."""
        out = {
            "status": self.status, "input_sources_count": self.sources, "input_rows_total": self.rows_in, "input_columns": self.columns_in, "output_rows": self.rows_out,
            "output_columns": self.columns_out, "output_file": self.file, "output_preview": self.preview, "execution_time_ms": self.milliseconds, "generation_info": self.generation,
            "generated_code": self.code, "warnings": self.warnings, "errors": self.errors, "timestamp": self.at.isoformat(),
        }
        return out if self.data is None else out | {"output_data": self.data}


def report(inputs: list[DataFrame], result: DataFrame, path: str, fmt: str = "csv", **more) -> Report:
    """Exports the result and tells what came of it, from one job for its rows."""
    began = time.monotonic()
    n = export(result, path, fmt)
    columns = list(dict.fromkeys(c for d in inputs for c in d.columns))
    return Report(
        "success", len(inputs), sum(d.count() for d in inputs), columns, n, result.columns, f"{path.rstrip('/')}" if fmt == "xlsx" else path, fmt, preview(result),
        int((time.monotonic() - began) * 1000), data=inline_rows(result), **more,
    )


def _cell(ref: str, v: object) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)):
        return f'<c r="{ref}"><v>{v!r}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'


def _letters(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def workbook(df: DataFrame) -> bytes:
    """One sheet, Sheet1. A sheet has a fixed greatest number of rows; more is an error."""
    rows = df.limit(WORKBOOK_ROWS + 1).collect()
    if len(rows) > WORKBOOK_ROWS:
        raise ValueError("too many rows for a sheet")
    lines = [list(df.columns)] + [list(r) for r in rows]
    body = "".join(f'<row r="{n}">' + "".join(_cell(f"{_letters(k)}{n}", v) for k, v in enumerate(line)) + "</row>" for n, line in enumerate(lines, 1))
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """What a dataset of answer chunks lists."""
    return chunks.select("slug", "title", "archetype_id", "category", "source_query", "quality_score", F.size("cites").alias("cites_count"), "cites")
