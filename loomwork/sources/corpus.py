"""Markdown corpora: folders of pages with front matter, and bundles of them."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.text import crossrefs

# What a corpus walk leaves out, and what a manifest must have.
SKIPPED_FOLDERS = ["_meta", ".plugs", ".git", ".github", "node_modules", "__pycache__"]
SKIPPED_FILES = ["log.md"]
MANIFEST_KEYS = ["format_version", "source", "wiki", "embeddings"]
VERSIONS = (1,)

PAGE = "slug string, title string, body string, content_full string, kind string, frontmatter map<string,string>, path string, error string"


class BundleError(ValueError):
    """A bundle that is not whole."""


def split_frontmatter(text: str) -> tuple[dict, str]:
    """(fields, body) of a page; a page need not have front matter."""
    import yaml

    found = re.match(r"\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\Z)", text, re.S)
    if not found:
        return {}, text.strip()
    fields = yaml.safe_load(found[1]) or {}
    if not isinstance(fields, dict):
        raise ValueError("front matter is not a mapping")
    return fields, text[found.end() :].strip()


def _as_json(v: object) -> str:
    return v if isinstance(v, str) else json.dumps(v, default=str, ensure_ascii=False)


def page_of(path: str, text: str) -> dict:
    """A row of PAGE. Front matter that does not parse is told in ``error``."""
    try:
        fields, body = split_frontmatter(text)
    except Exception as e:
        return {"slug": None, "title": None, "body": None, "content_full": None, "kind": None, "frontmatter": {}, "path": path, "error": str(e)[:500]}
    title = str(fields.get("title") or "")
    return {
        "slug": str(fields.get("slug") or path.replace(".md", "")), "title": title, "body": body, "content_full": f"{title}\n\n{body}",
        "kind": str(fields.get("kind") or "page"), "frontmatter": {str(k): _as_json(v) for k, v in fields.items()}, "path": path, "error": None,
    }


_SCHEMA = pa.schema([*[(c, pa.string()) for c in ("slug", "title", "body", "content_full", "kind")], ("frontmatter", pa.map_(pa.string(), pa.string())), ("path", pa.string()), ("error", pa.string())])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [page_of(p, t or "") for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        for r in rows:
            r["frontmatter"] = list(r["frontmatter"].items())
        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def parsed(files: DataFrame) -> DataFrame:
    """files: path (relative), text. Pages with page_ord (place in the order of paths) and crossrefs."""
    part = F.split("path", "/")
    folders = F.slice(part, 1, F.greatest(F.size(part) - 1, F.lit(0)))
    keep = ~F.arrays_overlap(folders, F.array(*[F.lit(s) for s in SKIPPED_FOLDERS])) & ~F.element_at(part, -1).isin(SKIPPED_FILES)
    rows = files.filter(keep).select("path", "text").mapInArrow(_parse, PAGE)
    # The order of paths is kept as a sortable key, so no task has to number the corpus.
    return rows.withColumn("page_ord", F.col("path")).withColumn("crossrefs", crossrefs(F.col("body"), F.col("frontmatter")))


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    full = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath().rstrip("/")
    path = F.url_decode(F.regexp_replace(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B")), "^[a-z0-9]+:/+", "/"))
    return parsed(files.select(F.substring(path, len(full) + 2, 1 << 20).alias("path"), F.col("value").alias("text")))


def markdown(page: dict) -> str:
    fields = {k: v for k, v in page.get("frontmatter", {}).items()}
    head = "".join(f"{k}: {json.dumps(v, ensure_ascii=False)}\n" for k, v in fields.items())
    return f"---\n{head}---\n\n{page['body']}\n"


def free_path(path: str, taken: set[str]) -> str:
    """The path, or with -2, -3 and so on the first that is free."""
    base, k = path, 2
    while path in taken:
        path, k = f"{base}-{k}", k + 1
    taken.add(path)
    return path


def validate_manifest(m: dict) -> None:
    for key in MANIFEST_KEYS:
        if key not in m:
            raise BundleError(f"manifest lacks {key}")
    if m["format_version"] not in VERSIONS:
        raise BundleError(f"format version {m['format_version']} is not supported")
    if not m["embeddings"].get("model") or not m["embeddings"].get("dims"):
        raise BundleError("manifest names no embedding model or dims")


def build_manifest(n_pages: int, n_chunks: int, n_edges: int, model: str, dims: int, thesis: dict | None = None, source: dict | None = None) -> dict:
    return {
        "format_version": 1, "compiler": "loomwork", "source": source or {"kind": "folder", "origin": ""},
        "wiki": {"pages_count": n_pages, "chunks_count": n_chunks, "crossref_edges": n_edges}, "thesis": thesis or {}, "embeddings": {"model": model, "dims": dims},
    }


def write_tables(tables: dict[str, DataFrame], manifest: dict, folder: str) -> None:
    """A bundle as a folder of Parquet tables beside its manifest; the form for large corpora."""
    validate_manifest(manifest)
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")


def read_tables(spark: SparkSession, folder: str, names: list[str]) -> tuple[dict, dict[str, DataFrame]]:
    rows = spark.read.text(f"{folder}/manifest").collect()
    if not rows:
        raise BundleError("no manifest")
    manifest = json.loads(rows[0][0])
    validate_manifest(manifest)
    return manifest, {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def write_bundle(pages: list[dict], vectors: dict[str, list[float]], manifest: dict, state: dict | None = None) -> bytes:
    """The interchange form: one zip of markdown, vectors and manifest. For corpora that one machine holds."""
    validate_manifest(manifest)
    out, taken = io.BytesIO(), set()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in pages:
            name = re.sub(r"[^a-zA-Z0-9_./-]+", "-", p["slug"]).strip("-/") or "page"
            z.writestr(free_path(name if p.get("kind") == "chunk" or "/" in name else f"pages/{name}", taken) + ".md", markdown(p | {"frontmatter": {"slug": p["slug"], "title": p["title"]} | p.get("frontmatter", {})}))
        order = list(vectors)
        buf = io.BytesIO()
        np.savez(buf, embeddings=np.array([vectors[s] for s in order], np.float32), slug_order=np.array(order))
        z.writestr("embeddings.npz", buf.getvalue())
        z.writestr("manifest.json", json.dumps(manifest))
        if state is not None:
            z.writestr("state.json", json.dumps(state))
    return out.getvalue()


def read_bundle(spark: SparkSession, content: bytes) -> tuple[dict, DataFrame, DataFrame, dict | None]:
    """(manifest, pages, vectors, state or None)."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise BundleError("not a zip archive") from e
    with z:
        names = z.namelist()
        for need in ("manifest.json", "embeddings.npz"):
            if need not in names:
                raise BundleError(f"bundle lacks {need}")
        manifest = json.loads(z.read("manifest.json"))
        validate_manifest(manifest)
        npz = np.load(io.BytesIO(z.read("embeddings.npz")), allow_pickle=False)
        matrix, order = npz["embeddings"], [str(s) for s in npz["slug_order"]]
        if len(matrix) != len(order):
            raise BundleError(f"{len(matrix)} vectors for {len(order)} slugs")
        files = [(n, z.read(n).decode()) for n in sorted(names) if n.endswith(".md")]
        state = json.loads(z.read("state.json")) if "state.json" in names else None
    pages = parsed(spark.createDataFrame(files, "path string, text string"))
    vectors = spark.createDataFrame([(s, v.tolist(), i) for i, (s, v) in enumerate(zip(order, matrix))], "slug string, embedding array<float>, row_ord long")
    return manifest, pages, vectors, state
