import json
import zipfile
from io import BytesIO

import pytest

from loomwork.operators.profile import bytes_of, schema_warnings, supertype, union_relaxed
from loomwork.sources import corpus as Co, sinks, tabular as T
from pyspark.sql import types as Ty


def test_formats_and_separators():
    assert [T.format_of(x) for x in ("a.CSV", "http://h/x.json?y=1", "p.parquet", "q.xlsx", "noext", "z.tsv")] == ["csv", "json", "parquet", "xlsx", "csv", "csv"]
    assert T.sniff_separator("a;b;c\n1,5;2") == ";" and T.sniff_separator("a,b;c") == "," and T.sniff_separator("x") == ","
    assert T.looks_like_html(b"  <!DOCTYPE HTML><p>") and not T.looks_like_html(b"a,b\n1,2")
    assert T.direct_download("https://drive.google.com/file/d/AbC-1/view").endswith("id=AbC-1&export=download&confirm=t")
    assert T.direct_download("https://h/x.csv") == "https://h/x.csv" and T.direct_download("https://drive.google.com/uc?id=Q_2").startswith("https://drive.usercontent.google.com/download?id=Q_2&")
    assert T.direct_download("https://drive.google.com/x") == "https://drive.google.com/x?confirm=t"
    assert T.looks_like_html(b"Google Drive - Virus scan warning")


def test_line_ends_quotes_and_blanks_in_values(spark, tmp_path):
    rows = [(1, 'a\nb "q", c'), (2, "x\r\ny"), (3, "  pad "), (4, None), (5, '"'), (6, "plain")]
    df = spark.createDataFrame(rows, "k long, v string")
    sinks.write_csv(df, str(tmp_path / "c"))
    back = T.read_csv(spark, str(tmp_path / "c"))
    assert back.dtypes == df.dtypes and sorted(map(tuple, back.collect())) == rows
    # the first such value far beyond what is looked at
    (tmp_path / "late.csv").write_text("k,v\n" + "1,x\n" * 30_000 + '2,"p\nq"\n')
    late = T.read_csv(spark, str(tmp_path / "late.csv"))
    assert late.count() == 30_001 and late.filter("k = 2").first().v == "p\nq"


def test_sheets_in_the_books_order_dates_and_errors(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = lambda rows: f'<worksheet {main}><sheetData>{rows}</sheetData></worksheet>'
    text = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
    first = f'<row r="1">{text("A1", "day")}{text("B1", "at")}{text("C1", "x")}</row><row r="2"><c r="A2" s="1"><v>45292</v></c><c r="B2" s="2"><v>45292.5</v></c><c r="C2" t="e"><v>#N/A</v></c></row><row r="3"><c r="C3"><v>2.5</v></c></row>'
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="b" sheetId="10" r:id="r10"/><sheet name="a" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r2" Target="worksheets/sheet10.xml"/><Relationship Id="r10" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet2.xml", sheet(first))
        z.writestr("xl/worksheets/sheet10.xml", sheet(f'<row r="1">{text("A1", "wrong")}</row>'))
    df = T.read_excel(spark, out.getvalue())
    assert df.dtypes == [("day", "date"), ("at", "timestamp_ntz"), ("x", "double")]
    assert [tuple(map(str, r)) for r in df.collect()] == [("2024-01-01", "2024-01-01 12:00:00", "None"), ("None", "None", "2.5")]


def test_sources_of_a_request():
    sources = T.sources_of({"uploadedFiles": ["u.csv"], "hostDatasetId": "d1", "datasetId": "d2", "resource": {"defaultDatasetId": "d3"}})
    assert [s.location for s in sources] == ["u.csv", "dataset:d1", "dataset:d2", "dataset:d3"]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "é")], "a long, b string")
    for fmt in sinks.MEDIA:
        r = sinks.report([df, df], df, str(tmp_path / f"out.{fmt}"), fmt, warnings=["w"]).to_dict()
        assert r["status"] == "success" and r["input_rows_total"] == 2 and r["output_rows"] == 1 and r["output_columns"] == ["a", "b"] and r["output_data"] == [{"a": 1, "b": "é"}]
    assert T.read(spark, T.Source(str(tmp_path / "out.xlsx"))).count() == 1
    with pytest.raises(ValueError):
        sinks.export(df, str(tmp_path / "x"), "odt")


def test_request_sources():
    both = T.sources_of({"inputData": {"s": [{"a": 1}], "p": []}, "datasetUrls": ["u.csv", {"url": "v.json", "name": "v"}], "datasetUrl": "ignored"})
    assert [(s.table_name, s.location) for s in both] == [("s", ""), ("p", ""), (None, "u.csv"), ("v", "v.json")]
    assert T.sources_of({"datasetUrl": "only.csv"})[0].location == "only.csv"
    assert T.sources_of({"inputData": {"a": 1}})[0].inline == [{"a": 1}]


def test_latin1_semicolons_nulls_and_types(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes("name;n;x;day\nCafé;1;N/A;2024-01-02\nÜber;-;2.5;2024-02-03\n".encode("latin-1"))
    df = T.read_csv(spark, str(tmp_path / "x.csv"))
    assert df.dtypes == [("name", "string"), ("n", "bigint"), ("x", "double"), ("day", "date")]
    assert [tuple(r)[:3] for r in df.collect()] == [("Café", 1, None), ("Über", None, 2.5)]


def test_web_page_is_refused(spark, tmp_path):
    (tmp_path / "x.csv").write_text("<html><body>sign in</body></html>")
    with pytest.raises(T.SourceError):
        T.read_csv(spark, str(tmp_path / "x.csv"))


def test_json_array_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": 1}, {"a": 2, "b": {"c": "x"}}]')
    (tmp_path / "b.json").write_text('{"a": 1}\n{"a": 2}\n')
    assert T.read_json(spark, str(tmp_path / "a.json")).count() == 2
    assert T.read_json(spark, str(tmp_path / "b.json")).count() == 2


def test_zip_order_and_workbooks(spark, tmp_path):
    def archive(files):
        out = BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n, b in files.items():
                z.writestr(n, b)
        return out.getvalue()

    assert T.zip_member(archive({"__MACOSX/a.csv": "x", "b.json": "[]", "c.csv": "a\n1"}))[0] == "c.csv"
    assert T.zip_member(b"a,b") is None
    with pytest.raises(T.SourceError):
        T.zip_member(archive({"__MACOSX/a.csv": "x"}))
    df = spark.createDataFrame([(1, "é<&", 2.5, True), (2, None, None, None)], "a long, b string, c double, d boolean")
    book = sinks.workbook(df)
    assert T.zip_member(book) is None
    (tmp_path / "w.xlsx").write_bytes(book)
    back = T.read(spark, T.Source(str(tmp_path / "w.xlsx")))
    assert back.dtypes == df.dtypes and [tuple(r) for r in back.collect()] == [tuple(r) for r in df.collect()]
    (tmp_path / "w.csv").write_bytes(archive({"in/t.csv": "a,b\n1,x\n"}))
    assert [tuple(r) for r in T.read(spark, T.Source(str(tmp_path / "w.csv"))).collect()] == [(1, "x")]


def test_named_tables_and_limits(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a\n1\n")
    named = T.load_named(spark, [T.Source(str(tmp_path / "t.csv")), T.Source(str(tmp_path / "t.csv")), T.Source(inline=[{"x": 1}])])
    assert list(named) == ["t", "t_2", "table_3"]
    assert T.register({"my-t x": named["t"]}) == {"my-t x": "df_my_t_x"} and spark.sql("select * from df_my_t_x").count() == 1
    with pytest.raises(T.SourceError):
        T.load(spark, [T.Source("x")] * 21)
    with pytest.raises(T.SourceError):
        T.read_inline(spark, [])


def test_union_and_supertypes(spark):
    a, b = spark.createDataFrame([(1, "x")], "i int, s string"), spark.createDataFrame([("y", 2.5)], "i string, d double")
    assert sorted(map(tuple, union_relaxed([a, b]).collect()), key=str) == sorted([("1", "x", None), ("y", None, 2.5)], key=str)
    assert supertype(Ty.IntegerType(), Ty.DoubleType()) == Ty.DoubleType() and supertype(Ty.LongType(), Ty.FloatType()) == Ty.DoubleType()
    assert supertype(Ty.IntegerType(), Ty.StringType()) == Ty.StringType() and supertype(Ty.DateType(), Ty.TimestampType()) == Ty.TimestampType()
    assert schema_warnings([a, b]) == ["table 2 lacks s", "table 2 also has d", "table 2 has i as string, not int"]
    assert [bytes_of(t) for t in (Ty.BooleanType(), Ty.IntegerType(), Ty.StringType(), Ty.ArrayType(Ty.LongType()))] == [1, 4, 50, 8]


def test_inline_output_limit(spark):
    df = spark.range(100).selectExpr("id", "case when id > 50 then 'é' end as s")
    assert len(sinks.inline_rows(df)) == 100 and sinks.inline_rows(df, 100) is None
    assert json.loads(sinks.json_array(df))[99] == {"id": 99, "s": "é"}
    assert len(sinks.preview(df, 0)) == sinks.PREVIEW
    assert sinks.write_counted is not None


PAGES = {
    "pages/alpha.md": '---\ntitle: "Alpha"\n---\nSee [[pages/beta|the beta page]].',
    "pages/beta.md": '---\ntitle: "Beta"\ncites: ["pages/alpha#x", "pages/none"]\nsources:\n  - slug: pages/gamma\n---\n',
    "pages/gamma.md": "No front matter, [[/pages/alpha]] and [[pages/gamma]].",
    "pages/bad.md": "---\ntitle: [\n---\nx",
    "_meta/skip.md": "x", "log.md": "x", "pages/log.md": "x", "note.txt": "x",
}


def test_corpus_from_a_folder(spark, tmp_path):
    from loomwork.operators.links import edges

    for name, text in PAGES.items():
        p = tmp_path / "my wiki" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    got = Co.read_corpus(spark, str(tmp_path / "my wiki"))
    rows = {r["path"]: r for r in got.collect()}
    assert sorted(rows) == ["pages/alpha.md", "pages/bad.md", "pages/beta.md", "pages/gamma.md"]
    assert rows["pages/bad.md"]["error"] and rows["pages/alpha.md"]["slug"] == "pages/alpha" and rows["pages/gamma.md"]["title"] == ""
    assert {tuple(r) for r in edges(got.filter("error is null")).collect()} == {("pages/alpha", "pages/beta"), ("pages/beta", "pages/alpha"), ("pages/beta", "pages/gamma"), ("pages/gamma", "pages/alpha")}


def test_bundles(spark, tmp_path):
    pages = [{"slug": "a b", "title": "A", "body": "x", "kind": "page"}, {"slug": "a?b", "title": "B", "body": "y", "kind": "page"}]
    m = Co.build_manifest(2, 0, 0, "hash", 2)
    content = Co.write_bundle(pages, {"a b": [1.0, 0.0], "a?b": [0.0, 1.0]}, m, {"pages": {}})
    manifest, got, vectors, state = Co.read_bundle(spark, content)
    assert manifest == m and state == {"pages": {}} and {r.slug for r in got.collect()} == {"a b", "a?b"} and vectors.count() == 2
    with pytest.raises(Co.BundleError):
        Co.read_bundle(spark, b"no zip")
    for bad in ({**m, "format_version": 99}, {k: v for k, v in m.items() if k != "wiki"}, {**m, "embeddings": {"model": "", "dims": 2}}):
        with pytest.raises(Co.BundleError):
            Co.validate_manifest(bad)
    Co.write_tables({"pages": got.drop("crossrefs"), "vectors": vectors}, m, str(tmp_path / "b"))
    again, tables = Co.read_tables(spark, str(tmp_path / "b"), ["pages", "vectors"])
    assert again == m and tables["vectors"].count() == 2
