"""CSV in ranges of bytes, against the standard reader of whole files."""

import csv
import io
import random

import pytest

from loomwork.sources import csv_ranges as R, tabular as T

HARD = ['a\nb', "x\r\ny", '"', '""', 'say "hi", he\n"said"\n', "\n\n\n", ",\n,", 'l1\n1,"fake",record\n2,x,y', "plain", "é ü", "5°"]


def written(path, rows, line_end="\r\n", encoding="utf-8", tail=""):
    out = io.StringIO()
    w = csv.writer(out, lineterminator=line_end)
    w.writerows([("k", "v", "w"), *rows])
    path.write_bytes((out.getvalue() + tail).encode(encoding))


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("line_end,encoding", [("\n", "utf-8"), ("\r\n", "utf-8"), ("\n", "latin-1")])
def test_one_file_in_many_tasks(spark, tmp_path, small_ranges, line_end, encoding):
    r = random.Random(len(line_end))
    rows = [(str(i), r.choice(HARD), "".join(r.choice(HARD) for _ in range(r.randint(1, 4)))) for i in range(900)]
    # values over several ranges, one of them without a quote inside
    rows[100] = ("100", "long\n" * 2000, "x")
    rows[500] = ("500", 'q"\n' * 1500, 'y\n"')
    written(tmp_path / "one.csv", rows, line_end, encoding)
    found = R.lines(spark, str(tmp_path / "one.csv"), "\n")
    assert found.select("file", "start").distinct().count() > 20
    df = T.read_csv(spark, str(tmp_path / "one.csv"), ",")
    got = sorted((r.k, r.v, r.w) for r in df.collect())
    assert df.rdd.getNumPartitions() > 4
    null = lambda v: None if v in T.NULLS else v
    assert got == sorted((int(k), null(v), null(w)) for k, v, w in rows)


def test_quotes_in_values_that_are_not_quoted(spark, tmp_path, small_ranges):
    lines = ['k,v,w'] + [f'{i},5" disk,x' if i % 3 else f'{i},"two\nlines",6" and 7"' for i in range(600)]
    (tmp_path / "x.csv").write_text("\n".join(lines) + "\n")
    got = {(r.k, r.v, r.w) for r in T.read_csv(spark, str(tmp_path / "x.csv")).collect()}
    assert got == {(i, '5" disk', "x") if i % 3 else (i, "two\nlines", '6" and 7"') for i in range(600)}


def test_several_files_with_headers_over_ranges(spark, tmp_path, small_ranges):
    folder = tmp_path / "many"
    folder.mkdir()
    name = "w\n" * 2000
    for f in range(3):
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([("k", name), *[(f * 1000 + i, f"a\n{i}") for i in range(300)]])
        (folder / f"f{f}.csv").write_text(out.getvalue() + "\n\n")
    df = T.read_csv(spark, str(folder), ",")
    assert len(df.columns) == 2 and {tuple(r) for r in df.collect()} == {(f * 1000 + i, f"a\n{i}") for f in range(3) for i in range(300)}


def test_lines_that_are_records_take_the_plain_way(spark, tmp_path):
    (tmp_path / "x.csv").write_text('k,v\n1,"a, b"\n2,5" disk\n')
    assert R.records(spark, str(tmp_path / "x.csv"), "utf-8", ",") is None
    assert [tuple(r) for r in T.read_csv(spark, str(tmp_path / "x.csv")).collect()] == [(1, "a, b"), (2, '5" disk')]


@pytest.mark.parametrize(
    "line,out,in_",
    [(b"a,b", False, True), (b'a,"b', True, True), (b'b",c', False, False), (b'"a","b"\r', False, False), (b'a"b,c', False, True), (b'""', False, True), (b'"a""', True, True), (b'","', False, True), (b'"a"x,b"', False, False), (b"", False, True)],
)
def test_a_line_from_either_state(line, out, in_):
    assert (R.after(line, False, ord(",")), R.after(line, True, ord(","))) == (out, in_)
