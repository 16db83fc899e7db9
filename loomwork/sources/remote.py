"""Sources beyond this machine: what their names mean, and staging of what was fetched.

Nothing here opens a connection. A fetcher is an argument: a function from a
location to bytes.
"""

from __future__ import annotations

import io
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession

from loomwork.runtime import shared_dir
from loomwork.sources.tabular import SourceError

Fetch = Callable[[str], bytes]


@dataclass(frozen=True)
class Repository:
    owner: str
    name: str
    folder: str = ""

    def archive(self, branch: str = "main") -> str:
        return f"https://codeload.github.com/{self.owner}/{self.name}/zip/refs/heads/{branch}"


def repository(spec: str) -> Repository:
    """owner/name or owner/name/folder."""
    parts = [p for p in spec.strip().strip("/").split("/") if p]
    if len(parts) < 2 or not all(re.fullmatch(r"[\w.-]+", p) for p in parts[:2]):
        raise SourceError(f"not owner/name: {spec}")
    return Repository(parts[0], parts[1], "/".join(parts[2:]))


def unpack(content: bytes, to: str) -> str:
    """Unzips into a folder; members that would leave it are refused. Returns the single top folder, if there is one."""
    root = os.path.realpath(to)
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for m in z.namelist():
            if not os.path.realpath(os.path.join(root, m)).startswith(root + os.sep):
                raise SourceError(f"{m} points outside the archive")
        z.extractall(root)
    inside = [n for n in os.listdir(root) if not n.startswith("__MACOSX")]
    return os.path.join(root, inside[0]) if len(inside) == 1 and os.path.isdir(os.path.join(root, inside[0])) else root


def fetch_repository(spec: str, to: str, fetch: Fetch, branch: str = "main") -> str:
    repo = repository(spec)
    folder = os.path.join(unpack(fetch(repo.archive(branch)), to), repo.folder)
    if not os.path.isdir(folder):
        raise SourceError(f"{spec} has no folder {repo.folder}")
    return folder


def stage_files(paths: list[str], to: str) -> int:
    """Copies markdown files side by side; equal names overwrite each other. Returns how many were copied."""
    os.makedirs(to, exist_ok=True)
    pages = [p for p in paths if p.endswith(".md")]
    for p in pages:
        shutil.copy(p, os.path.join(to, os.path.basename(p)))
    return len(pages)


def shared_copy(spark: SparkSession, folder: str) -> str:
    """A local folder's copy in the folder that driver and executors share, for Spark to read."""
    to = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    out = path(to)
    out.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).copyFromLocalFile(path("file://" + os.path.abspath(folder)), out)
    return to


def fetch_corpus(spark: SparkSession, config: dict, fetch: Fetch) -> str:
    """The corpus that a request names, fetched by the driver and put where executors can read it."""
    with tempfile.TemporaryDirectory() as local:
        return shared_copy(spark, corpus_folder(config, local, fetch))


def prior_bundle(config: dict, fetch: Fetch) -> bytes | None:
    """The bundle of the run before, by its address, else by its path; None if the request names none or it is not there."""
    if config.get("priorBundleUrl"):
        return fetch(config["priorBundleUrl"])
    path = config.get("priorBundlePath")
    if path and os.path.isfile(path):
        with open(path, "rb") as f:
            return f.read()
    return None


def corpus_folder(config: dict, to: str, fetch: Fetch) -> str:
    """Where a request's corpus lies after fetching: a repository, an archive, or uploaded files."""
    if config.get("githubRepo"):
        return fetch_repository(config["githubRepo"], to, fetch, config.get("githubBranch") or config.get("branch") or "main")
    if config.get("zipUrl"):
        return unpack(fetch(config["zipUrl"]), to)
    if config.get("uploadedFiles"):
        stage_files(config["uploadedFiles"], to)
        return to
    raise SourceError("the request names no corpus")
