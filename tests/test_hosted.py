"""Hosts and addresses, read by tasks."""

import io
import os
import zipfile
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from loomwork.sources import hosted as H, tabular as T


def a_host(log, items, most=10**9):
    """A fetcher of one dataset in pages, of at most ``most`` items each; writes down who asked for what."""

    def fetch(url):
        import json
        import os
        from urllib.parse import parse_qs, urlparse

        ask = {k: int(v[0]) for k, v in parse_qs(urlparse(url.replace("dataset:", "http://")).query).items()}
        with open(log, "a") as f:
            f.write(f"{os.getpid()} {ask['offset']} {ask['limit']}\n")
        return json.dumps(items(ask["offset"], min(ask["limit"], most))).encode()

    return fetch


@pytest.mark.parametrize("n", [1, 2, 7, 4321])
def test_a_dataset_of_many_pages(spark, tmp_path, n):
    log = str(tmp_path / "log")
    fetch = a_host(log, lambda at, limit: [{"z": k, "a": {"x": [k]}, **({"late": "y"} if k == n - 1 else {})} for k in range(at, min(at + limit, n))], most=300)
    df = H.read_items(spark, "dataset:d1", fetch, page=500, task=1000)
    assert df.columns == ["z", "a", "late"] and sorted((r.z, r.a.x[0]) for r in df.collect()) == [(k, k) for k in range(n)]
    assert df.filter("late = 'y'").count() == 1
    asked = [tuple(map(int, line.split())) for line in open(log)]
    driver = [a for a in asked if a[0] == os.getpid()]
    # the driver looks for the end with single items; the tasks fetch all items, each once
    assert len(driver) <= 3 + 2 * n.bit_length() and all(limit == 1 for _, _, limit in driver)
    assert len({pid for pid, _, _ in asked} - {os.getpid()}) >= 1
    tasks = Counter(at for pid, at, _ in asked if pid != os.getpid())
    assert max(tasks.values()) == 1 and {a // 1000 for a in tasks} == set(range(-(-n // 1000)))


def test_hosts_that_are_empty_or_shrink(spark, tmp_path):
    with pytest.raises(T.SourceError):
        T.read(spark, T.Source("dataset:none"), a_host(str(tmp_path / "l"), lambda at, limit: []))
    with pytest.raises(T.SourceError):
        T.read(spark, T.Source("dataset:d1"))
    assert H.count_items(lambda url: b"[1]" if "offset=0&" in url else b"[]", "d?token=t") == 1
    with pytest.raises(ValueError):
        H.items_of(lambda url: b"[1, 2, 3]", "d", 0, 2)
    shrinking = a_host(str(tmp_path / "m"), lambda at, limit: [{"a": 1}] if limit == 1 and at < 9 else [])
    with pytest.raises(Exception, match="shorter"):
        H.read_items(spark, "dataset:d", shrinking)


def test_files_behind_addresses(spark, tmp_path):
    log = str(tmp_path / "log")
    packed, sheet = io.BytesIO(), io.BytesIO()
    pq.write_table(pa.table({"k": list(range(25_000)), "s": ["é"] * 25_000}), packed)
    with zipfile.ZipFile(sheet, "w") as z:
        z.writestr("in/t.csv", 'a;b\n1;"x\ny"\n2;\n')
    answers = {
        "https://h/t.csv": "a,b\n1,é\n".encode("latin-1"), "https://h/t.json": b'[{"a": 1, "b": "x"}, {"a": 2}]', "https://h/l.json?v=1": b'{"a": 1}\n{"a": 2}', "https://h/p": packed.getvalue(),
        "https://h/z.zip": sheet.getvalue(), "https://h/page": b" <html>",
    }

    def fetch(url):
        import os

        with open(log, "a") as f:
            f.write(f"{os.getpid()} {url}\n")
        return answers[url]

    rows = lambda url: sorted(tuple(r) for r in T.read(spark, T.Source(url), fetch).collect())
    assert rows("https://h/t.csv") == [(1, "é")] and rows("https://h/l.json?v=1") == [(1,), (2,)]
    assert T.read(spark, T.Source("https://h/t.json"), fetch).count() == 2
    assert rows("https://h/p") == [(k, "é") for k in range(25_000)]
    assert {(r.a, r.b) for r in T.read(spark, T.Source("https://h/z.zip"), fetch).collect()} == {(1, "x\ny"), (2, None)}
    with pytest.raises(T.SourceError):
        T.read(spark, T.Source("https://h/page"), fetch)
    asked = [line.split() for line in open(log)]
    assert all(int(pid) != os.getpid() for pid, _ in asked) and max(Counter(u for _, u in asked).values()) == 1
