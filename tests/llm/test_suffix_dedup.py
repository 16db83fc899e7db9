import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from loomwork.llm import suffix_dedup as sd
from loomwork.llm.queries import queries
from tests.llm.helpers import DOC, edge_rows, stored


def brute(rows, length):
    seen = Counter()
    for t in rows:
        for s in range(len(t) - length + 1):
            seen[t[s : s + length]] += 1
    out = []
    for t in rows:
        gone = np.zeros(len(t) + 1, np.int8)
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = 1
        kept = bytes(c for c, f in zip(t, gone) if not f)
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def fixture():
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared = [text(rng.randint(350, 700)) for _ in range(5)]
    rows = []
    for i in range(60):
        t = "".join(rng.choice(shared) if rng.random() < 0.6 else text(rng.randint(1, 500)) for _ in range(rng.randint(0, 4)))
        t += rng.choice(["", "", "", "a" * 900, "ab" * 450, "lorem ipsum dolor " * 60])
        if rng.random() < 0.3 and len(t) > 50:
            x = rng.randrange(len(t))
            t = t[:x] + "é" + t[x + 1 :]
        rows.append((i, t, "en", "s", len(t)))
    return rows


@pytest.mark.parametrize("most", [1024, 4])
def test_bytes_match_brute_force(spark, tmp_path, most):
    df = stored(spark, fixture() + edge_rows()[:6], DOC, tmp_path / "d")
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.remove_repeats(df, most=most).collect())
    assert got == brute([(r.text or "").encode() for r in df.collect()], 400)


def test_edges_and_empty(spark, tmp_path):
    df = stored(spark, edge_rows(), DOC, tmp_path / "d")
    got = sd.remove_repeats(df).collect()
    assert len(got) == df.count()
    assert sd.remove_repeats(df.limit(0)).count() == 0
    kept = sd.without_repeats(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 2, 3, 4, 5}


def test_common_extension_survives_collisions():
    a, b = sd.Suffix(b"abcdef"), sd.Suffix(b"abcxyz")
    assert a.common(b) == 3
    b.hashes = a.hashes  # every hash collides
    assert a.common(b) == 3


def test_long_text_in_pieces():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 123, 3 * sd.PIECE, dtype=np.uint8)
    doc, pos, a, b = sd.cells_of(data, np.array([0]), np.array([len(data)]))
    whole = sd.window_anchors(data, sd.LENGTH, sd.K)
    covered = np.concatenate([np.arange(x, y + 1) for x, y in zip(a, b)])
    assert np.array_equal(covered, np.arange(len(whole)))
    assert np.array_equal(np.repeat(pos, b - a + 1), whole)


def brute_words(texts, words):
    """Words of each text inside a string of so many words that also starts elsewhere."""
    split = [t.encode().split() for t in texts]
    seen = Counter(tuple(w[s : s + words]) for w in split for s in range(len(w) - words + 1))
    out = []
    for w in split:
        gone = np.zeros(len(w), bool)
        for s in range(len(w) - words + 1):
            if seen[tuple(w[s : s + words])] > 1:
                gone[s : s + words] = True
        out.append(int(gone.sum()))
    return out


def passages():
    """Rows that share 49 to 54 words under 400 bytes, set between other words and white space of other kinds; ids tell the number."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(0, 200))), "en", "s", 1) for i in range(20)]
    for n in range(49, 55):
        shared = [word()[:6] for _ in range(n)]
        for i, sep in enumerate((" ", "\n", " \t")):
            rows.append((100 * n + i, " ".join(word() for _ in range(rng.randint(1, 60))) + sep + sep.join(shared) + f"{sep}é{n}.{i} " + word(), "en", "s", 1))
    return rows


@pytest.mark.parametrize("most", [1024, 4])
def test_passages_of_words_match_brute_force(spark, tmp_path, most):
    df = stored(spark, fixture() + passages() + edge_rows()[:6], DOC, tmp_path / "d")
    got = sd.remove_repeats(df, most=most).collect()
    rows = df.collect()
    want = brute_words([r.text or "" for r in rows], 51)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_repeated_words) for r in got) == sorted((str(r.doc_id), len((r.text or "").encode()), n) for r, n in zip(rows, want))


def test_a_passage_shorter_than_400_bytes_is_reported(spark, tmp_path):
    stored(spark, passages(), DOC, tmp_path / "documents.parquet")
    got = {r.doc_id: r for r in queries()["op1_suffix_dedup"](spark, str(tmp_path)).collect()}
    for n in range(49, 55):
        for i in range(3):
            r = got[100 * n + i]
            assert (r.n_removed, r.n_repeated_words) == (0, n if n > 50 else 0)
    assert all(r.n_repeated_words == 0 for k, r in got.items() if k < 20)


def test_long_text_is_coded_in_pieces():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 60))).encode() for _ in range(3 * sd.PIECE // 30)]
    white = [b" ", b"\t", b"\n\x0b ", b"\x0c\r"]
    texts = [b"".join(w + rng.choice(white) for w in words), b"", b" \n", "\u00e9\u00a0x y".encode(), b"z" * (2 * sd.PIECE) + b" end"]
    ends, data = sd.coded_words(np.cumsum([0, *map(len, texts)]), np.frombuffer(b"".join(texts), np.uint8))
    for t, x, y in zip(texts, ends.tolist(), ends[1:].tolist()):
        want = [w for w in re.split(rb"[\x20\x09-\x0d]+", t) if w]
        assert data[x:y].tobytes() == b"".join(hashlib.blake2b(w, digest_size=sd.WORD_BYTES).digest() for w in want)
