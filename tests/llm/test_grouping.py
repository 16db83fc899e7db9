"""Packing, spelling variants and clustering against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomwork.llm import kmeans, packing, spelling
from tests.llm.helpers import DOC, edge_rows, stored


# --- packing --------------------------------------------------------------------


def best_fit(lengths, capacity):
    """Sequences of a packing made piece by piece."""
    large, small = sorted((n for n in lengths if 3 * n > capacity), reverse=True), sorted((n for n in lengths if 3 * n <= capacity), reverse=True)
    gaps = []
    while large:
        a = large.pop(0)
        beside = next((n for n in large if n <= capacity - a), None)
        if beside is not None:
            large.remove(beside)
        gaps.append(capacity - a - (beside or 0))
    for n in small:
        fits = [g for g in gaps if g >= n]
        gap = min(fits, default=capacity)
        if fits:
            gaps.remove(gap)
        gaps.append(gap - n)
    return len(gaps)


def assert_gapless(placed, capacity):
    """placed: (sequence, offset, length) of every piece."""
    inside = defaultdict(list)
    for sequence, offset, length in placed:
        inside[sequence].append((offset, length))
    for pieces in inside.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(inside)


@pytest.mark.parametrize("seed", range(60))
def test_runs_of_equal_pieces_are_packed_as_one_by_one(seed):
    r = random.Random(seed)
    capacity = r.choice([1, 2, 7, 12, 30, 100])
    lengths = sorted(r.randint(1, capacity) if r.random() < 0.5 else r.randint(1, max(1, capacity // 4)) for _ in range(r.randint(0, 150)))
    counts = np.bincount(lengths, minlength=capacity + 1)
    runs, n = packing.pack_lengths(counts, capacity)
    assert n == best_fit(lengths, capacity)
    rank = np.concatenate([np.arange(c) for c in counts]).astype(np.int64)
    sequence, offset = packing.places(runs, np.array(lengths, np.int64), rank) if lengths else ([], [])
    assert assert_gapless(zip(map(int, sequence), map(int, offset), lengths), capacity) == n


def test_runs_are_bounded_by_the_capacity():
    counts = np.random.default_rng(3).integers(0, 10**10, 2049)
    counts[0] = 0
    runs, n = packing.pack_lengths(counts, 2048)
    assert len(runs) < 60_000 and int((runs[:, 2] * runs[:, 0]).sum()) == int((counts * np.arange(2049)).sum()) and n * 2048 >= int((counts * np.arange(2049)).sum())


def brute_ids(text):
    return packing.word_tokenizer().general.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packed_documents(spark, tmp_path, capacity):
    rows = edge_rows() + [(100 + i, "hello it's the WORLD " * (i % 40), "en", "s", 1) for i in range(120)]
    df = stored(spark, rows, DOC, tmp_path / "d", 5)
    got = packing.pack(df, capacity, with_ids=True).collect()
    want = Counter()
    for row in rows:
        ids = brute_ids(row[1])
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want[row[0], k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want
    n = assert_gapless([(r.sequence_id, r.offset, r.length) for r in got], capacity)
    assert n == best_fit([r.length for r in got], capacity)
    whole = packing.sequences(df, capacity=capacity).collect()
    assert len(whole) == n and sum(len(r.ids) for r in whole) == sum(r.length for r in got)
    assert all(len(r.ids) == sum(r.lengths) <= capacity and len(r.doc_ids) == len(r.lengths) for r in whole)


def test_packing_nothing(spark):
    df = packing.pack(spark.createDataFrame([], DOC))
    assert df.count() == 0 and df.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_word_ids_equal_the_library():
    tokenizer = packing.word_tokenizer()
    random_signs = random.Random(8)
    pools = ["abcdefgh'stremvl ", "AbÉé İıŐŒœÿßÀ", "0123456789²¼ ", "!?.,_-'\"<|endoftext|>", "\t\n\r \x0b\x0c\x00\x85\xa0 ", "ΣςΩ한日́😀‍", "–—“”…€"]
    for k in range(6000):
        signs = "".join(random_signs.sample(pools, random_signs.randint(1, 4)))
        text = "".join(random_signs.choice(signs) for _ in range(random_signs.randint(0, 40))) + random_signs.choice(["", "<|endoftext|>", "<|startoftext|> a", "they've it's 'S"])
        assert np.frombuffer(tokenizer.encode(text), "<u4").tolist() == tokenizer.general.encode(text, add_special_tokens=False).ids, repr(text)


# --- spelling ---------------------------------------------------------------------


def edit_neighbours(word, words):
    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        i = next((k for k, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
        return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i:]

    return [w for w in words if near(word, w)]


def brute_variants(rows, typo):
    counts = Counter()
    for row in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", row[1] or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if row[0] is None else row[0]}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % typo == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    near = {w: edit_neighbours(w, n) for w in n}
    best = {w: min(near[w], key=lambda o: (-n[o], o.encode()), default=None) for w in n}
    form = {w: o if o and n[o] >= 5 * n[w] else None for w, o in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), c, len(near[w]), n[form[w]] if form[w] else None) for w, c in n.items()}


@pytest.mark.parametrize("typo", [199, 7])
def test_variants_match_brute_force(spark, tmp_path, typo):
    r = random.Random(5)
    stems = ["".join(r.choice("abcdeé÷ÿ") for _ in range(r.randint(5, 9))) for _ in range(40)]
    pool = []
    for s in stems:
        pool += [s] * r.choice([5, 30, 200])
        for _ in range(4):
            i = r.randint(0, len(s))
            pool += [r.choice([s[:i] + r.choice("abéXÉ") + s[i:], s[:i] + s[i + 1 :], s[:i] + r.choice("abcéZ") + s[i + 1 :]])] * r.choice([3, 6, 8])
    # chains of forms, each five times as frequent as the one before
    for k, w in enumerate(["aaaaaa", "aaaaab", "aaaabb", "aaabbb", "aabbbb"]):
        pool += [w] * 5 ** (k + 1)
    r.shuffle(pool)
    rows = [(i if i % 9 else None, " ".join(pool[k : k + 50]) + r.choice(["", "\U0001f600", "×7", "_x"]), "en", "s", 1) for i, k in enumerate(range(0, len(pool), 50))]
    rows += edge_rows() + [(7000 + i, "Zzyzxe" * 3000, "en", "s", 1) for i in range(6)]
    df = stored(spark, rows, DOC, tmp_path / "d", 5)
    got = {(x.word, x.form, x.root, x.n, x.n_near, x.form_n) for x in spelling.variants(df, typo).collect()}
    want = brute_variants(rows, typo)
    assert got == want and any(x[2] != x[1] and x[1] for x in want)
    groups = {g.root: {(w.word, w.n) for w in g.words} for g in spelling.grouped(df, typo=typo).collect()}
    by_root = defaultdict(set)
    for x in want:
        by_root[x[2]].add((x[0], x[3]))
    assert groups == {k: v for k, v in by_root.items() if len(v) > 1}


def test_a_pair_meets_at_one_key(spark):
    words = spark.createDataFrame([("straße", 9), ("strasse", 5), ("strase", 5), ("gggggg", 7), ("ggggggg", 7), ("gggggggg", 7)], "word string, n long")
    pairs = sorted((r.word, r.other) for r in spelling.near_pairs(words).collect())
    assert pairs == sorted([("straße", "strase"), ("strase", "straße"), ("strasse", "strase"), ("strase", "strasse"), ("gggggg", "ggggggg"), ("ggggggg", "gggggg"), ("ggggggg", "gggggggg"), ("gggggggg", "ggggggg")])


def test_variants_of_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], DOC)).count() == 0


def test_spelling_broadcasts_no_list_of_words(spark, tmp_path, monkeypatch):
    """Twelve keys a word stand behind a compressed file that Spark takes for small, and would gather on the driver."""
    texts = ["abcdefgh " * 50, "abcdefg " * 5, "bcdefgh " * 6]
    df = stored(spark, [(i, x, "en", "s", 1) for i, x in enumerate(texts)], DOC, tmp_path / "d")
    plans, real = [], spelling.stored
    plan = lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or d
    monkeypatch.setattr(spelling, "stored", lambda d, name: real(plan(d), name))
    got = plan(spelling.variants(df, typo=10**12))
    assert {(r.word, r.root) for r in got.collect()} == {("abcdefgh", "abcdefgh"), ("abcdefg", "abcdefgh"), ("bcdefgh", "abcdefgh")}
    assert sum("Join" in x for x in plans) >= 3
    assert not any("Broadcast" in x for x in plans)


# --- clustering ---------------------------------------------------------------------


def lloyd(rows, k, rounds, dims, scale=64):
    kept = [(i, [int(np.floor(scale * float(c))) for c in v]) for i, v in rows if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) for c in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(v) for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), a in zip(kept, at) if a == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    per = Counter()
    for _, j, d in found:
        per[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, j, d, per[j], sum(per.values()), sha[j]) for i, j, d in found)


@pytest.mark.parametrize("k,dims,spread", [(16, 64, 1.0), (5, 2, 0.05), (16, 3, 0.03), (1, 4, 1.0), (40, 2, 0.02)])
def test_clusters_match_brute_force(spark, k, dims, spread):
    r = np.random.default_rng(k + dims)
    rows = [(i, [float(np.float32(c)) for c in r.normal(0, spread, dims)]) for i in range(150)]
    rows += rows[:20] + [(None, rows[3][1]), (900, None), (901, []), (902, [float("nan")] * dims), (903, [None] * dims), (904, [float("inf")] * dims), (905, [1.0] * (dims + 1)), (906, [0.0] * dims), (907, [0.0] * dims)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS cluster", "2 AS x", "3 AS distance").repartition(5)
    got = Counter((x.vec_id, x.cluster, x.distance, x.cluster_inertia, x.inertia, x.centroid_sha256) for x in kmeans.cluster(df, k, 3, dims).collect())
    assert got == lloyd(rows, k, 3, dims)


def test_bounds_hold_and_spare_distances():
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(c, 6, (200, 8)) for c in r.normal(0, 200, (30, 8))]).astype(np.int64)
    now, before, worked = x[r.permutation(len(x))[:30]].copy(), None, 0
    for _ in range(6):
        lists = kmeans.Lists(now)
        if before is None:
            at, upper, lower = lists.full(x)
        else:
            at, upper, lower, n = lists.search(x, at, *kmeans.moved(before, now, at, upper, lower))
            worked += n
        d2 = ((x[:, None, :] - now[None]) ** 2).sum(2)
        assert (at == d2.argmin(1)).all() and (upper >= np.sqrt(d2.min(1))).all() and (lower <= np.sqrt(np.sort(d2, 1)[:, 1])).all()
        before, now = now, np.array([x[at == j].sum(0) // (at == j).sum() if (at == j).any() else now[j] for j in range(len(now))])
    assert worked < 0.3 * 5 * len(x) * len(now)


def test_very_large_components(spark):
    rows = [(1, [3e38, 0.0]), (2, [-3e38, 0.0]), (3, [0.0, 0.0])]
    got = {r.vec_id: r.distance for r in kmeans.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 1, 1, 2).collect()}
    assert got[1] == pytest.approx(kmeans.MOST**2, rel=1e-6) and got[3] <= 1


def test_clusters_of_nothing(spark):
    assert kmeans.cluster(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
