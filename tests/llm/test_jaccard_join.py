import random
import re
from collections import Counter, defaultdict

import pytest

from loomwork.llm import jaccard_join as jj
from tests.llm.helpers import DOC, edge_rows, stored


def sets_of(texts):
    out = []
    for t in texts:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute(rows):
    sets = sets_of([t for _, t in rows])
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    places = defaultdict(list)
    for r, s in enumerate(sets):
        for x in s:
            places[x].append(r)
    for r, s in enumerate(sets):
        both = Counter(y for x in s for y in places[x] if y < r)
        for y, n in both.items():
            if 100 * n >= 80 * (len(s) + len(sets[y]) - n):
                parent[find(r)] = find(y)
    least = {}
    for r, (i, _) in enumerate(rows):
        if i is not None:
            least[find(r)] = min(least.get(find(r), i), i)
    return sorted((str(i), len(sets[r]), str(least.get(find(r)))) for r, (i, _) in enumerate(rows))


def fixture():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.randint(3, 80))] for _ in range(20)]
    line = [rng.choice(words) for _ in range(9)]
    rows = []
    for i in range(400):
        b = list(rng.choice(base)) if rng.random() < 0.8 else [rng.choice(words) for _ in range(rng.randint(0, 12))]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            if b:
                b[rng.randrange(len(b))] = rng.choice(words)
        b = line + b if rng.random() < 0.3 else b
        rows.append((i + 10, " ".join(x.upper() if rng.random() < 0.1 else x for x in b), "en", "s", 1))
    return rows


@pytest.mark.parametrize("options", [{}, {"least": 1}, {"frequent": 20}])
def test_components_match_brute_force(spark, tmp_path, options):
    df = stored(spark, fixture() + edge_rows(), DOC, tmp_path / "d")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jj.join(df, **options).collect())
    assert got == brute([(r.doc_id, r.text) for r in df.collect()])


def test_one_of_each(spark, tmp_path):
    df = stored(spark, fixture() + edge_rows(), DOC, tmp_path / "d")
    kept = jj.one_of_each(df)
    assert kept.columns == df.columns
    want = {c for _, n, c in brute([(r.doc_id, r.text) for r in df.collect()]) if n}
    rows = kept.collect()
    assert {str(r.doc_id) for r in rows if (r.text or "").split()} == want
    assert len(rows) == len(want) + sum(not (r.text or "").split() for r in df.collect())  # the wordless ones stay
    assert jj.join(df.limit(0)).count() == 0


def brute_links(rows):
    sets = sets_of([t for _, t in rows])
    linked = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    return sorted((str(i), sum(bool(linked(a, b)) for y, b in enumerate(sets) if y != x)) for x, ((i, _), a) in enumerate(zip(rows, sets)))


def alike(n):
    """Near copies of one text, all in one component but not all linked."""
    rng = random.Random(8)
    base = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(n):
        b = list(base)
        for _ in range(rng.randint(0, 3)):
            b[rng.randrange(len(b))] = f"x{rng.randrange(1000)}"
        rows.append((5000 + i, " ".join(b), "en", "s", 1))
    return rows


@pytest.mark.parametrize("options", [{}, {"least": 1}, {"frequent": 20}])
def test_links_inside_components_are_counted(spark, tmp_path, options, monkeypatch):
    monkeypatch.setattr(jj, "FAMILY_BLOCK", 40)
    df = stored(spark, fixture() + edge_rows() + alike(130), DOC, tmp_path / "d")
    got = sorted((str(r.doc_id), r.n_links) for r in jj.join(df, count_links=True, **options).collect())
    want = brute_links([(r.doc_id, r.text) for r in df.collect()])
    assert got == want
    inside = [n for i, n in want if i.isdigit() and int(i) >= 5000]
    assert 1 < sum(inside) < 130 * 129


def test_one_of_each_with_shared_and_null_ids(spark, tmp_path):
    one, two, three = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(5, one), (5, two), (7, two + " more"), (None, three), (None, three + " more"), (9, ""), (9, None)]
    df = stored(spark, [(i, t, "en", "s", 1) for i, t in rows], DOC, tmp_path / "d")
    kept = jj.one_of_each(df).collect()
    assert sorted((str(r.doc_id), (r.text or "")[:2]) for r in kept) == [("5", "a0"), ("5", "b0"), ("9", ""), ("9", ""), ("None", "c0")]


def test_sketches_bound_what_is_shared():
    import numpy as np

    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for _ in range(300):
        a, b = (np.unique(rng.choice(pool[: rng.integers(1, 3000)], rng.integers(1, 900))) for _ in range(2))
        both = len(np.intersect1d(a, b))
        assert jj.most_shared(jj.sketch(a), jj.sketch(b)) >= both
        assert jj.most_shared(jj.sketch(a), jj.sketch(a)) == len(a)
    crowded = np.arange(100, dtype=np.uint64) << np.uint64(12)  # all low bits alike: the sketch grows until no count runs over
    assert jj.most_shared(jj.sketch(crowded), jj.sketch(crowded)) == 100


def test_an_unstored_input_and_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(jj, "HOT_KEY", 3)
    monkeypatch.setattr(jj, "REMEMBERED", 4)
    rows = fixture()[:200] + alike(60)
    df = spark.createDataFrame(rows, DOC).repartition(5)  # rows in another order at every scan
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jj.join(df, least=2).collect())
    assert got == brute([(r[0], r[1]) for r in rows])


def test_texts_of_all_lengths_with_one_line_make_no_family(spark, tmp_path, monkeypatch):
    """A shingle that many unrelated texts hold by chance ties none of them together; lengths at the edge of what may be linked still meet."""
    import pyarrow as pa

    rng = random.Random(6)
    lines = [" ".join(f"l{k}_{i}" for i in range(5)) for k in range(300)]
    line = min(lines, key=lambda x: int(next(jj.shingle_sets(pa.array([x])))[0]))  # first in every text's order
    rows = [(i, " ".join([line, *(f"u{i}_{k}" for k in range(int(10 * 1.15**i)))])) for i in range(40)]
    for k in (1, 3, 7, 40):  # one has 4 k shingles, the other 5 k
        words = [f"e{k}_{rng.randrange(10**9)}" for _ in range(5 * k + 4)]
        rows += [(100 + k, " ".join(words[: 4 * k + 4])), (200 + k, " ".join(words))]
    families, real = [], jj._families
    monkeypatch.setattr(jj, "_families", lambda t: families.append((out := real(t)).count()) or out)
    df = stored(spark, [(i, t, "en", "s", 1) for i, t in rows], DOC, tmp_path / "d")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jj.join(df, least=10**6).collect())
    assert got == brute(rows)
    assert sum(c != i for i, _, c in got) == 4
    assert sum(families) == 0


def test_a_band_is_large_by_what_meets_across_components(spark):
    rows = [("one", c, 0 if c < 40 else c) for c in range(42)] + [("many", c, c) for c in range(42)] + [("huge", c, min(c, 1)) for c in range(200)] + [("joined", c, 7) for c in range(42)]
    keys = {k: i for i, k in enumerate(("one", "many", "huge", "joined"))}
    named = spark.createDataFrame([(keys[k], c, 1000, x, k) for k, c, x in rows], "key long, c long, n int, component long, what string")
    got = {(r.what, r.big) for r in jj._banded(named, 80).select("what", "big").collect()}
    assert got == {("one", False), ("many", True), ("huge", True)}
