import random
import zlib

import numpy as np
import pytest

from loomwork.llm import sentencepiece_bpe as sp, tokenfile as tf
from tests.llm.helpers import DOC, edge_rows, stored

P = pytest.importorskip("public_tokenizers")


def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sp.default_model())


def test_pieces_equal_the_library():
    table, lib, rng = sp.PieceTable(sp.default_model()), library(), random.Random(1)
    pool = [chr(x) for x in [*range(128), 233, 223, 0x2581, 0x3000, 0x1F600, 0x4E2D, 0xA0, 0x301]] + ["  ", "the ", "ing", "\r\n", "▁▁"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(rng.choice(table.pieces[300:]) for _ in range(rng.randint(0, 8))) for _ in range(3000)]
    for t in texts:
        ids = lib.encode(t)
        assert table.encode(t) == ids
        assert table.decode(ids) == lib.decode(ids)


def test_documents_equal_the_library(spark, tmp_path):
    import hashlib

    lib = library()
    df = stored(spark, edge_rows(), DOC, tmp_path / "d")
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in sp.encode_documents(df, with_ids=True).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in df.collect():
        ids = lib.encode(r.text or "")
        want.append((str(r.doc_id), len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)), tuple(ids)))
    assert got == sorted(want)
    assert sp.encode_documents(df.limit(0)).count() == 0


def test_code_lengths_are_optimal_within_the_limit():
    counts = np.array([0, 5, 9, 12, 13, 16, 45, 0, 1])
    lengths = tf.code_lengths(counts, 8)
    assert sum(2.0 ** -int(n) for n in lengths if n) == 1.0
    assert int((lengths * counts).sum()) == 234
    skewed = np.array([2**k for k in range(30)])
    short = tf.code_lengths(skewed, 6)
    assert short.max() <= 6 and sum(2.0 ** -int(n) for n in short) <= 1.0
    assert list(tf.code_lengths(np.array([0, 7]))) == [0, 1]


def test_pack_and_unpack():
    rng = np.random.default_rng(2)
    sizes = np.array([1, 513, 0, 2000, 512])
    ids = np.minimum(rng.geometric(0.01, int(sizes.sum())), 3000)
    lengths = tf.code_lengths(np.bincount(ids))
    bits, starts, offsets, blocks = tf.pack(ids, sizes, lengths, tf.canonical_codes(lengths))
    inner = np.arange(len(offsets)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    counts = np.minimum(tf.BLOCK, np.repeat(sizes, blocks) - inner * tf.BLOCK)
    assert np.array_equal(tf.unpack(bits, offsets, counts, tf.decoding_table(lengths)), ids)


def test_files_give_back_the_ids(spark, tmp_path):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    df = stored(spark, edge_rows(), DOC, tmp_path / "d")
    path = str(tmp_path / "ids")
    tf.write(df, path)
    got = tf.read(spark, path, with_ids=True).collect()
    want = {}
    for r in df.collect():
        want.setdefault(r.doc_id, []).append([*tk.encode(r.text or "", add_special_tokens=False).ids, 2])
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and r.ids in want[r.doc_id]
        assert r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0)) and len(got) == df.count()
    assert tf.round_trip(df.limit(0)).count() == 0


def test_plain_texts_have_the_named_librarys_ids():
    """Every text of a table and random strings of the characters that take the faster path."""
    from tokenizers import Tokenizer

    tk, own = Tokenizer.from_file(P.path("byte_bpe_50k.json")), tf.byte_tokenizer()
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()]
    rng = random.Random(8)
    plain = [c for c in map(chr, range(0x2100)) if tf.PLAIN.fullmatch(c)]
    texts += ["".join(rng.choices(plain, k=rng.randint(1, 12))) for _ in range(60_000)]
    texts += ["".join(rng.choice(["the", " ", "  ", "\n", "'s", "'LL", "1", "23", "é", "!?", "\t", "…"]) for _ in range(rng.randint(1, 12))) for _ in range(40_000)]
    assert sum(bool(tf.PLAIN.fullmatch(t)) for t in texts) > 100_000
    want = [e.ids for e in tk.encode_batch(texts, add_special_tokens=False)]
    assert [own.encode(t) for t in texts] == want


def test_parts_keep_the_order():
    rng = np.random.default_rng(4)
    ids = np.sort(rng.choice([3, 7, 7, 7, 7, 9, 12], 4000))
    hashes = rng.integers(-(1 << 63), (1 << 63) - 1, 4000)
    order = np.lexsort((hashes, ids))
    bounds = np.array([3, 7, 7, 7, 9])
    part = tf.parts_of(bounds, ids[order], hashes[order])
    assert (np.diff(part) >= 0).all() and part.min() >= 0 and part.max() <= len(bounds)
    assert len(set(part[ids[order] == 7].tolist())) == 4  # one id over several parts


def test_an_id_of_many_rows_is_spread(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tf, "SEGMENT_IDS", 100)
    monkeypatch.setattr(tf, "FILE_SEGMENTS", 2)
    rows = [(None if k % 2 else 5, f"text number {k} " * (k % 9), "en", "s", 1) for k in range(900)] + [(k, "x", "en", "s", 1) for k in range(100)]
    df = stored(spark, rows, DOC, tmp_path / "d")
    path = str(tmp_path / "ids")
    tf.write(df, path)
    assert len([f for f in (tmp_path / "ids").iterdir() if f.name.startswith("part-")]) > 8
    got = sorted(tf.read(spark, path).collect(), key=lambda r: r.start)
    assert len(got) == 1000 and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:])) and got[0].start == 0
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == sorted((r[0] is not None, r[0] or 0) for r in rows)
