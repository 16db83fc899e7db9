import io
import zipfile

import pytest

from loomwork.functions import prompts as P
from loomwork.sources import remote as R
from loomwork.sources.tabular import SourceError
from pyspark.sql import functions as F


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, b in files.items():
            z.writestr(n, b)
    return out.getvalue()


def test_repositories(tmp_path):
    assert R.repository("/a/b/docs/x/") == R.Repository("a", "b", "docs/x")
    with pytest.raises(SourceError):
        R.repository("a")
    asked = []
    fetch = lambda url: (asked.append(url), archive({"b-main/docs/p.md": "x", "b-main/q.md": "y"}))[1]
    assert R.fetch_repository("a/b/docs", str(tmp_path / "r"), fetch).endswith("b-main/docs") and asked[0].endswith("/a/b/zip/refs/heads/main")
    with pytest.raises(SourceError):
        R.fetch_repository("a/b/none", str(tmp_path / "s"), fetch)
    with pytest.raises(SourceError):
        R.unpack(archive({"../x": "x"}), str(tmp_path / "u"))
    with pytest.raises(SourceError):
        R.corpus_folder({}, "", fetch)


def test_staging(tmp_path):
    for d in ("a", "b"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "p.md").write_text(d)
    (tmp_path / "n.txt").write_text("x")
    assert R.stage_files([str(tmp_path / "a/p.md"), str(tmp_path / "b/p.md"), str(tmp_path / "n.txt")], str(tmp_path / "to")) == 2
    assert (tmp_path / "to/p.md").read_text() == "b"


def test_corpora_land_where_executors_read(spark, tmp_path):
    from loomwork.sources.corpus import read_corpus

    fetch = lambda url: archive({"b-main/p.md": "---\ntitle: P\n---\nx", "b-main/d/q.md": "y"})
    assert {r["path"] for r in read_corpus(spark, R.fetch_corpus(spark, {"githubRepo": "a/b"}, fetch)).collect()} == {"p.md", "d/q.md"}
    (tmp_path / "prior.zip").write_bytes(b"z")
    assert R.prior_bundle({"priorBundleUrl": "u", "priorBundlePath": str(tmp_path / "prior.zip")}, lambda u: b"web") == b"web"
    assert R.prior_bundle({"priorBundlePath": str(tmp_path / "prior.zip")}, fetch) == b"z" and R.prior_bundle({"priorBundlePath": "/none"}, fetch) is None


def test_excerpts_examples_and_memory(spark):
    pages = spark.createDataFrame([(f"p{i}", f"T{i}", "b" * 500, i) for i in range(40)], "slug string, title string, body string, page_ord long")
    text = P.excerpt_text(pages)
    assert text.count("## [[") == P.EXCERPT_PAGES and text.startswith("## [[p0]]: T0\n") and len(text.split("\n\n")[0]) < 330
    assert P.examples_text([("r", "SELECT 1")]).count("```") == 2 and P.memory_text([]) == "" and "0.91" in P.memory_text([{"score": 0.91, "prompt": "p", "code": "c"}])


def test_prompts(spark):
    assert P.code_in("Here:\n```sql\nSELECT 1\n```\nok") == "SELECT 1" and P.code_in(" SELECT 2 ") == "SELECT 2"
    df = spark.createDataFrame([("Here:\n```sql\nSELECT 1\n```", ), (" x ", )], "r string")
    assert [r[0] for r in df.select(P.code_column(F.col("r"))).collect()] == ["SELECT 1", "x"]
    assert P.schema_text(df.schema, 2, {"r": 1}, {"r": ["a"]}) == "2 rows\n- r: string, 1 nulls, e.g. a"
    ev = spark.createDataFrame([(1, 2, "B", "bbb"), (1, 1, "A", "aaa")], "k int, o int, t string, x string")
    assert P.evidence_text(ev, "k", "o", "t", "x", 2).first().evidence == "### A\naa\n\n### B\nbb"
    assert "Hint: h" in P.repair_prompt("r", "c", "p", "h")
