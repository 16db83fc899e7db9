import hashlib
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomwork.llm import common, fingerprint as fp, mixing, nearest, quality, toxicity, warc
from loomwork.llm.components import components
from tests.llm.helpers import DOC, edge_rows, stored


# --- components ---------------------------------------------------------------


@pytest.mark.parametrize("few", [0, 10_000])
def test_components_of_a_chain_and_a_star(spark, few):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), few=few).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(60))
    assert components(spark.createDataFrame([], "a long, b long"), few=few).count() == 0


def test_rows_are_numbered_once(spark):
    docs = spark.range(200).withColumn("Row", (F.rand() * 1e9).cast("long"))  # other rows at every scan
    name = common.free_name(docs, "row")
    one = common.numbered(docs, name)
    first, again = (sorted(map(tuple, one.repartition(k).collect())) for k in (2, 5))
    assert name == "_row" and first == again and len({r[2] for r in first}) == 200
    common.drop_stored(one)


# --- quality --------------------------------------------------------------------


def brute_kn(texts, trusted, order):
    """Interpolated modified Kneser-Ney by dictionaries."""
    from collections import Counter

    grams = [Counter() for _ in range(order + 1)]
    for t in trusted:
        for g in quality.grams(np.frombuffer(t, np.uint8), order).tolist():
            grams[order][g] += 1
    for k in range(order - 1, 0, -1):
        for g in grams[k + 1]:
            grams[k][g & (quality.SYMBOLS**k - 1)] += 1
    cuts = []
    for k in range(1, order + 1):
        n = [max(1, sum(1 for c in grams[k].values() if c == j)) for j in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        cuts.append([min(j, max(0.05, j - (j + 1) * y * n[j] / n[j - 1])) for j in (1, 2, 3)])
    total, given = [Counter() for _ in range(order + 1)], [Counter() for _ in range(order + 1)]
    for k in range(1, order + 1):
        for g, c in grams[k].items():
            total[k][g >> quality.BITS] += c
            given[k][g >> quality.BITS] += cuts[k - 1][min(c, 3) - 1]

    def p(g, k):
        if k == 0:
            return 1 / quality.SYMBOLS
        g &= quality.SYMBOLS**k - 1
        h, c = g >> quality.BITS, grams[k].get(g, 0)
        low = p(g, k - 1)
        if not total[k][h]:
            return low
        return (c - cuts[k - 1][min(c, 3) - 1] if c else 0) / total[k][h] + given[k][h] / total[k][h] * low

    return [float(np.exp(-np.mean([np.log(p(g, order)) for g in quality.grams(np.frombuffer(t, np.uint8), order).tolist()]))) if t else 1.0 for t in texts]


def test_perplexity_matches_brute_force(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Über"]) for _ in range(rng.randint(0, 30))), "en", "s", 1) for i in range(40)]
    df = stored(spark, rows, DOC, tmp_path / "d")
    trusted = spark.createDataFrame([(i,) for i in range(25)], "doc_id long")
    got = {r.doc_id: r.perplexity for r in quality.perplexities(df, trusted).collect()}
    want = brute_kn([r[1].encode() for r in rows], [r[1].encode() for r in rows[:25]], quality.ORDER)
    assert [got[i] for i in range(40)] == pytest.approx(want, rel=1e-4)


def test_an_id_with_more_text_than_a_block_is_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK_BYTES", 2000)
    rng = random.Random(31)
    rows = [(7 if i % 2 else i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "Über"]) for _ in range(rng.randint(1, 30))), "en", str(i), 1) for i in range(60)]
    df = stored(spark, rows, DOC, tmp_path / "d")
    trusted = spark.createDataFrame([(7,), (2,), (4,)], "doc_id long")
    sizes = df.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("n"))
    assert [r.doc_id for r in quality._hot_ids(sizes).filter("parts > 2").collect()] == [7]
    got = quality.perplexities(df, trusted).collect()
    want = brute_kn([r[1].encode() for r in rows], [r[1].encode() for r in rows if r[0] in (7, 2, 4)], quality.ORDER)
    assert sorted((r.doc_id, r.perplexity) for r in got) == [(i, pytest.approx(w, rel=1e-4)) for i, w in sorted(zip((r[0] for r in rows), want))]


def test_quality_edges(spark, tmp_path):
    df = stored(spark, edge_rows(), DOC, tmp_path / "d")
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (6, 1, 0), (4, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(df, labels).collect()
    assert len(got) == df.count() and all(r.keep for r in got if r.n_bytes == 0)
    none = quality.classify(df, labels.limit(0)).collect()
    assert all(r.keep and r.threshold is None for r in none)
    assert quality.classify(df.limit(0), labels).count() == 0


def test_no_symbols_are_folded(spark, tmp_path):
    assert len(set(quality.grams(np.arange(256, dtype=np.uint8), 1).tolist())) == 256
    rng = random.Random(6)
    clean = lambda: " ".join(rng.choice(["größe", "straße", "über", "haus", "garten", "wetter"]) for _ in range(40))
    rows = [(i, clean(), "de", "s", 1) for i in range(60)]
    # bytes that were alike when 128 of them had 22 classes, letters in another case, other control bytes
    junk = [clean().translate({ord("ö"): "\u00cc", ord("ß"): "\u00c9"}), clean().upper(), clean().replace(" ", "\x01").replace("e", "E")]
    rows += [(100 + k, t, "de", "s", 1) for k, t in enumerate(junk)]
    df = stored(spark, rows, DOC, tmp_path / "d")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(df, labels).collect()}
    assert not any(got[100 + k].keep for k in range(3))
    assert all(got[100 + k].perplexity > 1.5 * max(got[i].perplexity for i in range(60)) for k in range(3))


def test_a_small_language_has_its_own_threshold(spark, tmp_path):
    rng = random.Random(9)
    text = lambda words: " ".join(rng.choice(words) for _ in range(30))
    rows = [(i, text(["alpha", "beta", "gamma"]), "xx" if i < 5 else "en", "s", 1) for i in range(40)]
    rows += [(100 + i, "".join(rng.choice("abcdefghij ") for _ in range(200)), "en", "s", 1) for i in range(40)]
    df = stored(spark, rows, DOC, tmp_path / "d")
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0] >= 2], "doc_id long, quality int, toxic int")
    got = quality.classify(df, labels).collect()
    limit = {lang: {r.threshold for r in got if r.lang == lang} for lang in ("en", "xx")}
    assert len(limit["en"]) == len(limit["xx"]) == 1 and 2 * max(limit["xx"]) < min(limit["en"])


def test_thresholds_and_kept_rows_match_brute_force(spark, tmp_path):
    rng = random.Random(12)
    text = lambda words: " ".join(rng.choice(words) for _ in range(rng.randint(4, 25)))
    rows = [(i, text(["alpha", "beta", "gamma"] if i % 3 else ["uno", "dos", "tres"]), ["es", "en", None][i % 3], "s", 1) for i in range(60)]
    rows += [(100 + i, "".join(rng.choice("abxyz ") for _ in range(60)), "en", "s", 1) for i in range(10)]
    df = stored(spark, rows, DOC, tmp_path / "d")
    labels = spark.createDataFrame([(i, int(i % 7 != 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(df, labels, quantile=0.8).collect()}
    half = {r.doc_id: r.half for r in df.select("doc_id", quality._half(F.col("doc_id"))).collect()}
    texts = [r[1].encode() for r in rows]
    trusted = [r[0] for r in rows if r[0] < 60 and r[0] % 7]
    model = lambda keep: dict(zip((r[0] for r in rows), brute_kn(texts, [r[1].encode() for r in rows if r[0] in keep], quality.ORDER)))
    whole, by = model(set(trusted)), [model({i for i in trusted if half[i] == h}) for h in (0, 1)]
    lang = {r[0]: r[2] for r in rows}
    for name in ("en", "es", None):
        seen = sorted(by[1 - half[i]][i] for i in trusted if lang[i] == name)
        limit = seen[-(-8 * len(seen) // 10) - 1]
        for i in (i for i in lang if lang[i] == name):
            assert got[i].threshold == pytest.approx(limit, rel=1e-4) and got[i].perplexity == pytest.approx(whole[i], rel=1e-4)
            assert got[i].keep == (whole[i] <= limit) or abs(whole[i] / limit - 1) < 1e-4


# --- archives -------------------------------------------------------------------


@pytest.mark.parametrize("version", [1, 2])
def test_arc_lines_and_lengths(version):
    bodies = [b"HTTP/1.1 200 OK\r\n\r\nx\n\ny", b"", b"a\nb 12\n"]
    content = warc.arc_file("f.arc", version, [(f"http://h/{k} é", "text/html", b) for k, b in enumerate(bodies)])
    got = list(warc.read_arc(content))
    assert [r.body for r in got[1:]] == bodies and {r.version for r in got} == {version}
    assert got[1].fields["URL"] == "http://h/0%20%C3%A9" and len(got[1].fields) == len(warc.ARC_FIELDS[version])
    with pytest.raises(ValueError):
        list(warc.read_arc(content[:-20]))
    with pytest.raises(ValueError):
        list(warc.read_arc(b"http://h/ 0.0.0.0 19990101 text/html 0\n\n"))


def test_warc_headers():
    rec = list(warc.read_arc(warc.arc_file("f.arc", 1, [("http://h/", "text/html", b"HTTP/1.1 200 OK\r\nX-Page-Id: 4\r\nContent-Length: 2\r\n\r\nhi")])))[1]
    headers, block = next(warc.read_warc(warc.warc_record(rec) + b"\r\n\r\n"))
    assert headers["WARC-Type"] == "response" and block == rec.body and headers["WARC-Date"] == "1999-12-31T23:59:59Z"
    assert headers["WARC-Record-ID"] == next(warc.read_warc(warc.warc_record(rec) + b"\r\n\r\n"))[0]["WARC-Record-ID"]
    assert warc.iso_date("19990102") == "1999-01-02T00:00:00Z"
    headers, block = next(warc.read_warc(warc.warc_record(rec, 9) + b"\r\n\r\n"))
    assert headers["WARC-Type"] == "revisit" and headers["WARC-Refers-To-Page"] == "9" and b"hi" not in block


def test_archives_give_back_pages(spark, tmp_path):
    x = "y\r\n\r\nz" * 300
    rows = [(None, "a b", x), (3, None, x), (3, None, x), (7, "http://é/ö", None), (9, "u", x[:-1]), (8, "u\n v", x[:-1]), (None, None, "s"), (10, "v", "short"), (11, "w", "short")]
    df = stored(spark, rows, "page_id long, url string, html string", tmp_path / "p")
    warc.write_archives(df, str(tmp_path / "w"))
    got = warc.read_archives(spark, str(tmp_path / "w"), with_payload=True).collect()
    assert sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in got) == sorted(
        [("None", 1800, "revisit", "3"), ("3", 1800, "response", "None"), ("3", 1800, "revisit", "3"), ("7", 0, "response", "None"), ("9", 1799, "response", "None"), ("8", 1799, "revisit", "9"), ("None", 1, "response", "None"), ("10", 5, "response", "None"), ("11", 5, "response", "None")]
    )
    html = {(r.page_id, len((r.html or "").encode())): (r.html or "").encode() for r in df.collect()}
    for r in got:
        body = html[(r.page_id, r.payload_bytes)]
        assert r.payload_digest == hashlib.sha1(body).hexdigest() and (r.record_type == "revisit" or bytes(r.payload) == body)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_long_pages_and_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 3000)
    monkeypatch.setattr(warc, "ARC_BYTES", 5000)
    rng = random.Random(2)
    rows = [(i, f"http://h/{i}", "".join(rng.choice("abcdefgh\0\n") for _ in range(rng.choice([0, 5, 3000])))) for i in range(40)] + [(99, "long", "x\r\n\r\n" * 700_000)]
    df = stored(spark, rows, "page_id long, url string, html string", tmp_path / "p")
    warc.write_archives(df, str(tmp_path / "w"))
    files = [f for f in (tmp_path / "w").iterdir() if f.name.startswith("part-")]
    assert len(files) > 10
    got = {r.page_id: bytes(r.payload) for r in warc.read_archives(spark, str(tmp_path / "w"), with_payload=True).collect()}
    assert got == {i: html.encode() for i, _, html in rows}
    import gzip

    whole = b"".join(gzip.decompress(f.read_bytes()) for f in files)  # any reader of gzip members will do
    assert sum(h["WARC-Type"] != "warcinfo" for h, _ in warc.read_warc(whole)) == 41
    with pytest.raises(ValueError):
        list(warc.read_members(files[0].read_bytes()[:-9]))


# --- nearest --------------------------------------------------------------------


def test_extreme_parts(spark):
    big = 1e308
    rows = [(0, [big, big]), (1, [big, 0.9 * big]), (2, [-big, big]), (3, [float("inf"), 1.0]), (4, [1e-300, 1e-300]), (5, [1.0, float("-inf")])]
    got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r.vec_id, round(r.score, 3)) for r in sorted(got, key=lambda r: r.rank)] == [(4, 1.0), (1, 0.999), (2, 0.0)]


def test_recall_and_order(spark, tmp_path):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16))
    x[100] = x[150] = x[200]  # ties
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(5000, None, 0), (5050, [0.0] * 16, 0), (5100, [float("nan")] * 16, 0), (5150, [None] * 16, 0), (5200, [1.0], 0), (None, [1.0] * 16, 0), (50, x[50].tolist(), 0)]
    df = stored(spark, rows, "vec_id long, embedding array<double>, label int", tmp_path / "e")
    got = {}
    for r in nearest.search(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 50))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q, rows_ in got.items():
        s = unit @ unit[q]
        s[q] = -2
        want = sorted(range(3000), key=lambda i: (-s[i], i))[:5]
        rows_.sort()
        assert [r[0] for r in rows_] == [1, 2, 3, 4, 5] and [(-round(r[2], 12), r[1]) for r in rows_] == sorted((-round(r[2], 12), r[1]) for r in rows_)
        hit += len(set(want) & {r[1] for r in rows_})
    assert hit / (5 * len(got)) >= 0.9
    assert [r[1] for r in got[200]][:2] == [100, 150]
    assert nearest.search(df.limit(0)).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in nearest.search(two).collect()] == [(0, 1)]


def test_graph_search_finds_the_nearest_lists():
    rng = np.random.default_rng(5)
    c = rng.normal(size=(600, 12))
    c = nearest.Centroids(c / np.linalg.norm(c, axis=1, keepdims=True))
    x = rng.normal(size=(50, 12)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, _ = c.search(x, 32)
    want = np.argsort(-(x @ c.points.T), axis=1)[:, :8]
    assert np.mean([len(set(a[:8]) & set(b)) / 8 for a, b in zip(ids, want)]) > 0.95


# --- fingerprints ---------------------------------------------------------------


def test_fingerprints(spark, tmp_path):
    df = stored(spark, edge_rows() + [(20, "a. b. c.", "en", "s", 1), (21, "c. a. b.", "en", "s", 1)], DOC, tmp_path / "d")
    got = fp.edited_likeness(df).collect()
    assert len(got) == df.count()
    text = {}
    for r in df.collect():
        text.setdefault(r.doc_id, r.text or "")
    one = {r.doc_id: r for r in got}
    ids = sorted((i for i in text if i is not None), reverse=True)
    for a, b in [(21, 20), (20, 8), (8, 7), (6, 5), (5, 4), (4, 3), (3, 2)]:
        m = len(text[a]) // 3
        edited = text[a][: len(text[a]) - m] + text[b][:m]
        assert one[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and one[a].n_chars == len(text[a])
    assert ids[0] == 21 and one[2].fingerprint == one[3].fingerprint  # null and empty
    same = {r.doc_id: r.fingerprint for r in fp.fingerprint(df).collect()}
    assert same[20] == same[21] and same[20] == one[20].fingerprint  # order of passages does not matter
    assert len({r.fingerprint for r in got if r.doc_id == 1}) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert one[8].near_edited > 0.5
    assert fp.edited_likeness(df.limit(0)).count() == 0
    alone = stored(spark, [(1, "only", "en", "s", 4)], DOC, tmp_path / "one")
    assert fp.edited_likeness(alone).first().near_next == 1.0


def vector(passages):
    """The parts of a fingerprint, summed passage by passage."""
    out = [0] * (1 + fp.LANES + len(fp.STRONG))
    seeded = lambda p, seed: xxhash.xxh64(struct.pack("<i", seed), seed=xxhash.xxh64(p, seed=42).intdigest()).intdigest()
    for p in passages:
        out[0] += 1
        lanes = [h >> (k + 32 * j) & 1 for h in (seeded(p, s) for s in fp.SEEDS) for k in range(fp.SUMS) for j in (0, 1)]
        for i, x in enumerate(lanes + [seeded(p, s) & 0xFFFFFFFF for s in fp.STRONG], 1):
            out[i] += x
    return [out[0], *[x % 2**20 for x in out[1 : 1 + fp.LANES]], *[x % 2**32 for x in out[1 + fp.LANES :]]]


def passages_of(text):
    # to Java a character beyond the first plane ends in a half that counts as one beyond ASCII
    return [p.encode() for p in re.split(fp.CUT.replace(r"\uFFFF", r"\U0010FFFF"), text, flags=re.ASCII) if p]


def parsed(text):
    at = fp.AT_STRONG - 1
    threes = [int(text[i : i + 15], 16) for i in range(16, at, 15)]
    return [int(text[:16], 16), *[x >> 20 * j & fp.MASK20 for x in threes for j in range(3)], *[int(text[i : i + 8], 16) for i in range(at, len(text), 8)]]


def alike(a, b):
    if a == b:
        return 1.0
    x, y = (np.array([2 * c - v[0] for c in v[1 : 1 + fp.LANES]], float) for v in (a, b))
    norm = np.sqrt(x @ x) * np.sqrt(y @ y)
    return float(np.clip(x @ y / norm, 0, 1)) if norm else 0.0


def test_fingerprints_match_brute_force(spark, tmp_path):
    rng = random.Random(7)
    word = lambda: rng.choice(["über ", "and. ", "x\n", "so, ", "und ", "\U0001f600 ", "k9 ", "naïve "])
    rows = [(i * 7, "".join(word() for _ in range(rng.randint(0, 40))), "en", "s", 1) for i in range(60)]
    df = stored(spark, rows, DOC, tmp_path / "d")
    got = {r.doc_id: r for r in fp.edited_likeness(df).collect()}
    down = sorted(rows, reverse=True)
    for (i, text, *_), (_, following, *_) in zip(down, down[1:] + down[:1]):
        m = len(text) // 3
        edited = text[: len(text) - m] + following[:m]
        a, b, c = (vector(passages_of(t)) for t in (text, edited, following))
        r = got[i]
        assert parsed(r.fingerprint) == a and parsed(r.edited_fingerprint) == b and r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(alike(a, b), abs=1e-9) and r.near_next == pytest.approx(alike(a, c), abs=1e-9)


def test_passages_are_inserted_and_deleted(spark):
    one, two = "first part.\nsecond part;\n", "third!\nsecond part;\nand a fourth\n"
    of = {r.doc_id: r.fingerprint for r in fp.fingerprint(spark.createDataFrame([(1, one), (2, two), (3, one + two), (4, two + one), (5, None)], "doc_id long, text string")).collect()}
    pairs = spark.createDataFrame([(of[1], of[2], of[3], of[5])], "a string, b string, c string, e string")
    got = pairs.select(
        fp.added(F.col("a"), F.col("b")), fp.removed(F.col("c"), F.col("b")), fp.removed(F.col("c"), F.col("c")), fp.added(F.col("a"), F.col("e")), fp.passage_count(F.col("c"))
    ).first()
    assert tuple(got) == (of[3], of[1], of[5], of[1], len(passages_of(one + two))) and of[3] == of[4]


def test_counting_lanes_of_very_many_passages(spark):
    """Lanes are summed 32 bits apart, so the sum of 2^21 equal passages is that of one, times 2^21, modulo 2^20."""
    n = (1 << 21) + 3
    many = spark.range(1).select(F.lit(1).alias("doc_id"), F.expr(f"repeat('a,', {n})").alias("text"))
    got = parsed(fp.fingerprint(many).first().fingerprint)
    one = vector([b"a,"])
    assert got == [n, *[x * n % 2**20 for x in one[1 : 1 + fp.LANES]], *[x * n % 2**32 for x in one[1 + fp.LANES :]]]


def test_ranges_with_many_rows_are_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fp, "HOT_RANGE", 8)
    monkeypatch.setattr(fp, "CELL_ROWS", 4)
    rows = [(rng_id, f"text {k}", "en", "s", 1) for k, rng_id in enumerate([None] * 60 + [5] * 50 + [6] * 3 + list(range(200, 400, 9)) + [-3])]
    df = stored(spark, rows, DOC, tmp_path / "d")
    got = fp.with_next_text(df).collect()
    assert len(got) == len(rows) and len({(r.bucket, r["sub"]) for r in got}) > 30
    hashed = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashed[r[1]]))
    following = {a[1]: b[1] for a, b in zip(order, order[1:] + order[:1])}
    assert {r.text: r.next_text for r in got} == following


def test_successors_over_levels(spark):
    keys = [1, 5, 6, 1000, 2000, 2001, -7]
    got = {r.k: r.next_k for r in fp.successors(spark.createDataFrame([(k,) for k in keys], "k long"), bits=2, small=2).collect()}
    down = sorted(keys, reverse=True)
    assert got == dict(zip(down, [*down[1:], None]))


# --- mixing -----------------------------------------------------------------------


def targets(sizes, weights=mixing.WEIGHTS):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, open_, budget = {}, set(order), float(sum(sizes.values()))
    while open_:
        level = budget / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level >= 3 * sizes[s]}
        if not over:
            return out | {s: w[s] * level for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
            budget -= out[s]
        open_ -= over
    return out


def test_shares(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i + 100, "w " * rng.randint(0, 40), "en", rng.choice(["a", "b", "z", "é", "\U0001f600", "￮", None]), 1) for i in range(1200)] + edge_rows()
    df = stored(spark, rows, DOC, tmp_path / "d")
    got = mixing.mix(df).collect()
    assert len(got) == df.count() and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df).collect()), key=str)
    sizes, source = {}, {}
    for r in df.collect():
        n = len((r.text or "").split())
        sizes[r.source] = sizes.get(r.source, 0) + n
        source[r.doc_id] = r.source
    want, taken = targets(sizes), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
    for r in (r for r in got if r.doc_id not in (1, None)):
        assert r.target == pytest.approx(want[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]]
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    assert sum(r.taken for r in got) == sum(sizes.values())
    biggest = max(r["size"] for r in got)
    assert all(abs(taken.get(s, 0) - want[s]) <= biggest + 60 for s in want)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == sum(r.taken for r in got)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0


def brute_mix(rows, seed=17):
    """rows: (doc_id, text, source). (row, words) of every copy served, and taken by row, by one queue after another."""
    long_hash = lambda x, s: s if x is None else xxhash.xxh64(struct.pack("<q", x), seed=s).intdigest()
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    start = xxhash.xxh64(struct.pack("<i", seed), seed=42).intdigest()
    text_hash = lambda t: signed(42 if t is None else xxhash.xxh64(t.encode(), seed=42).intdigest())
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    key = [signed(long_hash(text_hash(t), long_hash(i, start))) for i, t, _ in rows]
    sums = Counter()
    for n, (_, _, s) in zip(size, rows):
        sums[s] += n
    target = targets(dict(sums))
    queue = []
    for s in sums:
        upto = 0
        for r in sorted((r for r in range(len(rows)) if rows[r][2] == s and size[r]), key=lambda r: ((key[r] >> 20) % (1 << 20), key[r], rows[r][0] is not None, rows[r][0] or 0, r)):
            upto += size[r]
            queue += [((upto + e * sums[s]) / target[s], key[r], e, r) for e in range(3) if upto + e * sums[s] - size[r] < target[s]]
    copies, left = [], sum(size)
    for _, _, _, r in sorted(queue):
        if left > 0:
            copies.append((r, min(size[r], left)))
            left -= copies[-1][1]
    taken = Counter()
    for r, n in copies:
        taken[r] += n
    return copies, taken


def test_mix_matches_brute_force(spark, tmp_path):
    rng = random.Random(19)
    rows = [(rng.choice([None, 7, i, i + 1000]), " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randint(0, 30))) if i % 40 else None, "en", rng.choice(["b", "a", "ä", None]), 1) for i in range(700)]
    df = stored(spark, rows, DOC, tmp_path / "d")
    plain = [(r[0], r[1], r[3]) for r in rows]
    copies, taken = brute_mix(plain)
    ends = lambda n, t: " ".join((t or "").split()[:n]) if n < len((t or "").split()) else t
    got = sorted((str(r.doc_id), r["size"], r.taken) for r in mixing.mix(df).collect())
    assert got == sorted((str(i), len((t or "").split()), taken[r]) for r, (i, t, _) in enumerate(plain))
    mixed = sorted((str(r.doc_id), str(r.text)) for r in mixing.mixed_documents(df).collect())
    assert mixed == sorted((str(plain[r][0]), str(ends(n, plain[r][1]))) for r, n in copies)


def test_running_sums_over_levels(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", None]), rng.randrange(300), rng.randint(1, 9)) for _ in range(900)]
    df = spark.createDataFrame([(g, c, v, k) for k, (g, c, v) in enumerate(rows)], "g string, cell int, v int, k long")
    for bits in (2, 10):
        got = {r.k: r.total for r in mixing.running_sum(df, ["g"], ["cell", "k"], "v", "cell", 300, "total", bits).collect()}
        for g in ("a", None):
            at = 0
            for k, (_, _, v) in sorted(((k, r) for k, r in enumerate(rows) if r[0] == g), key=lambda x: (x[1][1], x[0])):
                at += v
                assert got[k] == at


# --- toxicity ---------------------------------------------------------------------


def test_pairs_of_terms_are_learned():
    """Toxic is who has both or neither: no additive weights can tell."""
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(2000):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.array([k for k, f in ((0, a), (1, b)) if f] + [2], np.int64))
        y.append(float(a and b))
    m = toxicity.fit(np.arange(3), rows, np.array(y))
    z = [m.margin(x) for x in ([2], [0, 2], [1, 2], [0, 1, 2])]
    assert max(z[:3]) < 0 < z[3]


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.classify(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    rank, pos = got.score.rank(), got.toxic == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.96
    assert (got.toxic[got.predicted == 1] == 1).mean() > 0.9 and (got.predicted[pos] == 1).mean() > 0.7


def test_scores_match_brute_force(spark, tmp_path):
    """Every score is the sum over all pairs of terms, worked out pair by pair."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["idiot", "you", "people", "sun", "rain", "Garten", "été"]) for _ in range(rng.randint(0, 9))), "en", "s", 1) for i in range(150)]
    df = stored(spark, rows, DOC, tmp_path / "d")
    labels = spark.createDataFrame([(i, 1, int("idiot" in r[1] and "people" in r[1])) for i, r in enumerate(rows)], "doc_id long, quality int, toxic int")
    model = toxicity.train(df, labels)
    at = {int(t): k for k, t in enumerate(model.terms)}
    for r in toxicity.score(df, model).collect():
        x = sorted(at[h] for h in toxicity.text_terms(rows[r.doc_id][1]) if h in at)
        z = model.bias + sum(model.weights[i] for i in x) + sum(model.factors[i] @ model.factors[j] for i in x for j in x if i < j)
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), rel=1e-6)
        assert r.predicted == int(r.score >= 0.7)


def test_repeated_ids_do_not_pass_the_bound_on_what_is_learnt_from(spark, tmp_path, monkeypatch):
    rows = [(k % 2, f"you idiot people {k}" if k % 2 else f"sun and rain {k}", "en", "s", 1) for k in range(300)]
    df = stored(spark, rows, DOC, tmp_path / "d")
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 1)], "doc_id long, quality int, toxic int")
    assert df.select(toxicity.held_out("doc_id").alias("h")).distinct().collect() == [(False,)]
    seen = []
    plain = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda terms, rows, *more: seen.append(len(rows)) or plain(terms, rows, *more))
    monkeypatch.setattr(toxicity, "LEAST_TEXTS", 1)
    toxicity.train(df, labels, rows=2)
    assert seen == [2]


def test_archives_of_pages_without_ids(spark, tmp_path):
    df = stored(spark, [(None, f"u{k}", "y" * 2000) for k in range(3)], "page_id long, url string, html string", tmp_path / "p")
    assert [(r.record_type, r.refers_to) for r in warc.round_trip(df).collect()] == [("response", None)] * 3


def test_toxicity_edges(spark, tmp_path):
    df = stored(spark, edge_rows(), DOC, tmp_path / "d")
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (6, 1, 0), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(df, labels).collect()
    assert len(got) == df.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    empty = toxicity.classify(df, labels.limit(0)).collect()
    assert {r.score for r in empty} == {0.5} and {r.predicted for r in empty} == {0}
    assert toxicity.classify(df.limit(0), labels).count() == 0
    assert toxicity.without_toxic(df, toxicity.train(df, labels.limit(0))).count() == df.count()
