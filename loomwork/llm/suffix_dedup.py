"""Suffix-array dedup: find every byte inside a string of LENGTH bytes that also starts elsewhere.

1. Each window of LENGTH bytes picks one anchor inside it: the k-gram with the
   least hash. Equal windows pick equal anchors at equal offsets, so repeats can
   only be among suffixes that start at anchors with one key. About one byte in
   170 is an anchor. Neighbouring windows with one anchor make a cell.
2. Keys that occur once are done. Cells with equal content are counted, not
   compared: all their windows repeat (those of one document travel as one row).
   Content counts as equal only by a cryptographic digest of 128 bits, so that a
   collision of hashes never removes a byte. What is left is one cell of each
   content of a key with several contents.
3. These are compared by suffix sorting: prefix polynomial hashes and binary
   search give the common extension of two suffixes in logarithmic time, merge
   sort puts suffixes in order, to the right of the anchor and (reversed) to the
   left of it, and neighbours' common extensions give those of all pairs. Each
   extension found by hashes is verified on the bytes.
4. Keys with too many contents for one task are refined: whoever shares LENGTH
   bytes shares half of what is still missing on the left or on the right, so the
   group is dealt by the digests of either half, again and again.

Strings of words are found the same way, in texts coded in WORD_BYTES bytes a
word: windows of so many words are then windows of so many bytes. A passage of 51
words is often shorter than LENGTH bytes, so nothing of it is removed; what of a
document stands in such passages is counted in a column of its own.

Rows are numbered once, in a copy in buckets, so the input may be any DataFrame
and texts are not shuffled again.

Defined results: null text is empty; texts under LENGTH bytes keep everything;
rows with one id are separate documents; very long texts are handled in pieces;
an empty table gives no rows; other columns are not used, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import cmp_to_key

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import columns_of, drop_stored, free_name, numbered, stored, text_bytes, text_of

LENGTH = 400
K = 64
#: Words that make a passage: over 50.
PASSAGE = 51
#: Bytes of a word's digest in coded texts. Words are told apart by it alone.
WORD_BYTES = 8
#: What parts words, see common.WORD; bytes.split() parts them there too.
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Contents of one key that a task compares.
MOST = 4096
#: Bytes of text that are hashed at a time.
PIECE = 1 << 19
#: Bits for a place in a piece, below those of its hash. The same for all pieces, so that equal windows pick equal anchors.
PLACE_BITS = np.uint64(21)
assert PIECE + 2**16 < 1 << int(PLACE_BITS)

_rng = np.random.default_rng(20240)
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.cumprod(out, out=out)
    return out


_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _tables:
        _tables[size] = (_powers(BASE, size), _powers(INVERSE, size))
    up, down = _tables[size]
    return up[:n], down[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """h[i]: the polynomial hash of the first i bytes, modulo 2^64."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up, out=out[1:])
    return out


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A well mixed hash of each k-gram, the same wherever it stands."""
    h = prefix_hashes(data)
    n = len(data) - k + 1
    _, down = powers(n)
    x = (h[k:] - h[:n]) * down
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(29)
    return x


def window_anchors(data: np.ndarray, length: int, k: int) -> np.ndarray:
    """For each window start, where the window's least k-gram starts (the first of equals)."""
    w = length - k + 1
    x = gram_hashes(data, k)
    x = (x >> PLACE_BITS << PLACE_BITS) | np.arange(len(x), dtype=np.uint64)
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])
    return (least & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)


def _cells(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, k: int):
    """(document, anchor, first window, last window) of every cell, in positions of ``data``."""
    if len(data) < length:
        return [np.zeros(0, np.int64)] * 4
    anchor = window_anchors(data, length, k)
    sizes = np.maximum(0, ends - starts - length + 1)
    doc = np.repeat(np.arange(len(starts)), sizes)
    at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    here = anchor[at]
    new = np.ones(len(at), bool)
    new[1:] = (here[1:] != here[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return [doc[first], here[first], at[first], at[last]]


def cells_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, k: int = K):
    """As _cells, PIECE bytes at a time; a document longer than that is cut into overlapping pieces."""
    i, out = 0, []
    while i < len(starts):
        j = i + 1
        while j < len(starts) and ends[j] - starts[i] <= PIECE:
            j += 1
        lo, hi = int(starts[i]), int(ends[j - 1])
        if hi - lo <= PIECE or j > i + 1:
            d, p, a, b = _cells(data[lo:hi], starts[i:j] - lo, ends[i:j] - lo, length, k)
            out.append((d + i, p + lo, a + lo, b + lo))
        else:
            parts = []
            for at in range(lo, hi - length + 1, PIECE):
                to = min(hi, at + PIECE + length - 1)
                _, p, a, b = _cells(data[at:to], np.array([0]), np.array([to - at]), length, k)
                if parts and len(p) and parts[-1][1][-1] == p[0] + at:  # one cell across two pieces
                    parts[-1][3][-1] = b[0] + at
                    p, a, b = p[1:], a[1:], b[1:]
                if len(p):
                    parts.append((np.full(len(p), i), p + at, a + at, b + at))
            out += parts
        i = j
    if not out:
        return [np.zeros(0, np.int64)] * 4
    return [np.concatenate(c) for c in zip(*out)]


class _Codes(dict):
    """The digest of each word; a bounded number of short ones is remembered."""

    def __missing__(self, word: bytes) -> bytes:
        made = hashlib.blake2b(word, digest_size=WORD_BYTES).digest()
        if len(word) <= 40:
            if len(self) >= 200_000:
                self.clear()
            self[word] = made
        return made


_codes = _Codes()


def _coded(text: bytes) -> bytes:
    """The digests of a text's words, about PIECE bytes split at a time."""
    out, at = [], 0
    while at < len(text):
        white = SPACE.search(text, at + PIECE)
        to = white.start() if white else len(text)
        out.append(b"".join(map(_codes.__getitem__, text[at:to].split())))
        at = to
    return b"".join(out)


def coded_words(ends: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As text_bytes(), of the texts in WORD_BYTES bytes a word."""
    at = ends.tolist()
    out = [_coded(data[x:y].tobytes()) for x, y in zip(at, at[1:])]
    return np.cumsum([0, *map(len, out)], dtype=np.int64), np.frombuffer(b"".join(out), np.uint8)


def plain_bytes(ends: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return ends, data


# --- suffix order inside one key ------------------------------------------------


class Suffix:
    """Bytes that follow an anchor in one direction, with their prefix hashes."""

    __slots__ = ("data", "hashes")

    def __init__(self, data: bytes):
        self.data = data
        self.hashes = prefix_hashes(np.frombuffer(data, np.uint8))

    def common(self, other: Suffix) -> int:
        """Length of the common extension: binary search on prefix hashes, then verified."""
        a, b = self.hashes, other.hashes
        lo, hi = 0, min(len(self.data), len(other.data))
        if a[hi] == b[hi]:
            lo = hi
        while lo < hi:
            mid = (lo + hi + 1) >> 1
            if a[mid] == b[mid]:
                lo = mid
            else:
                hi = mid - 1
        if self.data[:lo] == other.data[:lo]:
            return lo
        x, y = np.frombuffer(self.data[:lo], np.uint8), np.frombuffer(other.data[:lo], np.uint8)
        return int(np.flatnonzero(x != y)[0])  # a collision of hashes


def merge_order(suffixes: list[Suffix]) -> tuple[list[int], list[int]]:
    """(order, common extensions of neighbours) by merge sort; sorted() merges runs."""

    def compare(i: int, j: int) -> int:
        a, b = suffixes[i], suffixes[j]
        n = a.common(b)
        x, y = a.data[n : n + 1], b.data[n : n + 1]
        return (x > y) - (x < y)

    order = sorted(range(len(suffixes)), key=cmp_to_key(compare))
    return order, [suffixes[i].common(suffixes[j]) for i, j in zip(order, order[1:])]


def _shared(near: np.ndarray, at: int) -> np.ndarray:
    """Common extensions of the suffix at a place of the order with those at all places, from sorted neighbours: the least of those between."""
    out = np.zeros(len(near) + 1, np.int32)
    out[at + 1 :] = np.minimum.accumulate(near[at:])
    out[:at] = np.minimum.accumulate(near[:at][::-1])[::-1]
    return out


def repeated_around(contents: list[bytes], lefts: list[int], length: int, wanted: list[bool] | None = None) -> list[tuple[int, int]]:
    """For each wanted content, how many bytes left and right of its anchor repeat in another; (0, 0) if none.

    All repeats hold the anchor, so what they cover is one run. Memory grows with
    the contents, not with their pairs.
    """
    right = [Suffix(c[o:]) for c, o in zip(contents, lefts)]
    left = [Suffix(c[:o][::-1]) for c, o in zip(contents, lefts)]
    if len(contents) == 2:
        r, l = right[0].common(right[1]), left[0].common(left[1])  # noqa: E741
        return [(l, r) if l + r >= length else (0, 0)] * 2
    orders = []
    for suffixes in (left, right):
        order, near = merge_order(suffixes)
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        orders.append((at, np.array(near, np.int32)))
    out = []
    for i in range(len(contents)):
        if wanted is not None and not wanted[i]:
            out.append((0, 0))
            continue
        l, r = (_shared(near, at[i])[at] for at, near in orders)  # noqa: E741
        ok = l + r >= length
        ok[i] = False
        out.append((int(l[ok].max()), int(r[ok].max())) if ok.any() else (0, 0))
    return out


# --- over tables ------------------------------------------------------------------


#: What tells one content of a key from another: 128 bits of a cryptographic digest.
CLASS = ["cls", "cls2"]


def _digests(view: memoryview, spans) -> np.ndarray:
    """Two 64-bit numbers for each (first byte, end, bytes before the anchor)."""
    from hashlib import blake2b

    raw = b"".join([blake2b(view[x:y], digest_size=16, salt=before.to_bytes(8, "little")).digest() for x, y, before in spans])
    return np.frombuffer(raw, np.int64).reshape(-1, 2)


def _anchors(rows: DataFrame, length: int, k: int, coded: Callable) -> DataFrame:
    names = ["key", "cls", "cls2", "row", "n", "pos", "a", "b", "more"]

    def run(batches):
        import xxhash

        key_of = xxhash.xxh3_64_intdigest
        for batch in batches:
            ids = batch.column(0).to_numpy()
            ends, data = coded(*text_bytes(batch.column(1)))
            view = memoryview(data)
            doc, pos, a, b = cells_of(data, ends[:-1], ends[1:], length, k)
            keys = np.fromiter((key_of(view[p : p + k]) for p in pos.tolist()), np.uint64, len(pos)).view(np.int64)
            sums = _digests(view, zip(a.tolist(), (b + length).tolist(), (pos - a).tolist()))
            base = ends[:-1][doc]
            pos, a, b = pos - base, a - base, b - base
            first, n, more = _folded(doc, keys, sums, a, b + length)
            for x in range(0, len(first), 20_000):
                at = first[x : x + 20_000]
                cols = [pa.array(v[at]) for v in (keys, sums[:, 0], sums[:, 1])] + [pa.array(ids[doc[at]]), pa.array(n[x : x + 20_000]), *[pa.array(v[at]) for v in (pos, a, b)], pa.array(more[x : x + 20_000], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.select("row", "text").mapInArrow(run, "key long, cls long, cls2 long, row long, n long, pos long, a long, b long, more binary")


def _folded(doc, keys, sums, lo, hi):
    """(first cell of each content in a document, how many there are, the union of their spans if several)."""
    order = np.lexsort((np.arange(len(doc)), sums[:, 1], sums[:, 0], keys, doc))
    columns = [c[order] for c in (doc, keys, sums[:, 0], sums[:, 1])]
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns]) if len(order) else new[1:]
    starts = np.flatnonzero(new)
    n = np.diff(np.append(starts, len(order)))
    more: list = [None] * len(starts)
    for k in np.flatnonzero(n > 1).tolist():
        at = order[starts[k] : starts[k] + n[k]]
        x, y = lo[at], hi[at]  # ascending, of equal length
        apart = np.concatenate([[True], x[1:] > y[:-1]])
        last = np.append(np.flatnonzero(apart)[1:], len(at)) - 1
        more[k] = np.column_stack([x[apart], y[last]]).astype("<i8").tobytes()
    return order[starts], n.astype(np.int64), more


def _contents(rows: DataFrame, ships: DataFrame, length: int, coded: Callable) -> DataFrame:
    """The bytes of each chosen cell: key, row, pos, left (bytes before the anchor), single, content."""
    wanted = ships.groupBy("row").agg(F.collect_list(F.struct("key", "pos", "a", "b", "single")).alias("cells"))

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        pack = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["key", "row", "pos", "left", "single", "content"])
        for batch in batches:
            ends, data = coded(*text_bytes(batch.column(1)))
            out = []
            for row, at, own in zip(batch.column(0).to_pylist(), ends.tolist(), batch.column(2)):
                for c in own.as_py():
                    out.append((c["key"], row, c["pos"], c["pos"] - c["a"], c["single"], data[at + c["a"] : at + c["b"] + length].tobytes()))
                    if len(out) >= 4096:
                        yield pack(out)
                        out = []
            if out:
                yield pack(out)

    joined = rows.join(wanted, "row").select("row", "text", "cells")
    return joined.mapInArrow(run, "key long, row long, pos long, left long, single boolean, content binary")


def _compared(contents: DataFrame, length: int) -> DataFrame:
    """row, lo, hi of what repeats in single cells, key by key in sorted partitions."""

    def run(batches):
        key, held = None, []

        def solve():
            if len(held) < 2:
                return []
            found = repeated_around([h[4] for h in held], [h[2] for h in held], length, [h[3] for h in held])
            return [(h[0], h[1] - l, h[1] + r) for h, (l, r) in zip(held, found) if h[3] and l + r >= length]

        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["row", "lo", "hi"])

        for batch in batches:
            out = []
            for k, *rest in zip(*[c.to_pylist() for c in batch.columns]):
                if k != key:
                    out += solve()
                    key, held = k, []
                held.append(rest)
            if out:
                yield batch_of(out)
        if out := solve():
            yield batch_of(out)

    return contents.repartition("key").sortWithinPartitions("key").mapInArrow(run, "row long, lo long, hi long")


def _refined(contents: DataFrame, length: int, most: int) -> list[DataFrame]:
    """Spans of keys with more than ``most`` contents, by dealing them finer until they are few enough."""

    def deal(batches):
        from hashlib import blake2b

        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64()]
        for batch in batches:
            out = []
            for key, key2, row, pos, left, single, content, lmin, rmin in zip(*[c.to_pylist() for c in batch.columns]):
                half = (length - lmin - rmin + 1) // 2
                for side, x, y in ((0, lmin + half, rmin), (1, lmin, rmin + half)):
                    if x <= left and y <= len(content) - left:
                        part = content[left - x : left - lmin] if side == 0 else content[left + rmin : left + y]
                        # the digest of a digest: equal only if all parts so far are
                        made = blake2b(part, digest_size=16, key=np.array([key, key2], "<i8").tobytes(), person=bytes([side]) + half.to_bytes(4, "little")).digest()
                        out.append((*np.frombuffer(made, "<i8").tolist(), row, pos, left, single, content, x, y))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    names = ["key", "key2", "row", "pos", "left", "single", "content", "lmin", "rmin"]
    schema = "key long, key2 long, row long, pos long, left long, single boolean, content binary, lmin long, rmin long"
    # A key is a hash of K bytes; those that share it without sharing these bytes part here.
    spans, level = [], contents.withColumn("key2", F.xxhash64(F.substring("content", F.col("left").cast("int") + 1, F.lit(K)))).withColumn("lmin", F.lit(0).cast("long")).withColumn("rmin", F.lit(K).cast("long"))
    group = ["key", "key2", "lmin", "rmin"]
    while True:
        level = stored(level.select(*names).mapInArrow(deal, schema), "cells")
        # Groups of contents that are known to repeat tell nothing more.
        sizes = stored(level.groupBy(*group).agg(F.count("*").alias("n"), F.max("single").alias("asks")).filter("n > 1 and asks").drop("asks"), "sizes")
        level = level.join(sizes, group)
        # Those that share LENGTH bytes by now need no comparison.
        whole = level.filter(F.col("lmin") + F.col("rmin") >= length)
        spans.append(whole.filter("single").select("row", (F.col("pos") - F.col("lmin")).alias("lo"), (F.col("pos") + F.col("rmin")).alias("hi")))
        rest = level.filter(F.col("lmin") + F.col("rmin") < length)
        few = rest.filter(F.col("n") <= most)
        spans.append(_compared(few.withColumn("key", F.xxhash64(*group)).select("key", "row", "pos", "left", "single", "content"), length))
        level = rest.filter(F.col("n") > most)
        if sizes.filter((F.col("n") > most) & (F.col("lmin") + F.col("rmin") < length)).isEmpty():
            return spans


def repeated_spans(rows: DataFrame, length: int = LENGTH, k: int = K, most: int = MOST, coded: Callable = plain_bytes) -> DataFrame:
    """row, lo, hi, more: byte spans that make up all that repeats (``more``: several, as pairs). ``rows``: row, text.

    ``coded`` gives the bytes that are searched and that spans count. ``read_from``
    of the result are stored tables that it reads and nothing else does.
    """
    anchors = stored(_anchors(rows, length, k, coded), "anchors")
    several = F.min("cls") != F.max("cls")
    several = (several | (F.min("cls2") != F.max("cls2"))).alias("mixed")
    # A table of its own, so that the join below has an exchange on either side and can split a hot key.
    keys = stored(anchors.groupBy("key").agg(F.sum("n").alias("n"), several).filter("n > 1").drop("n"), "keys")
    cells = stored(anchors.join(keys, "key"), "cells")
    drop_stored(anchors, keys)
    span = ["row", F.col("a").alias("lo"), (F.col("b") + length).alias("hi"), "more"]
    whole = cells.filter("not mixed").select(*span)
    mixed = cells.filter("mixed").drop("mixed")
    kinds = stored(mixed.groupBy("key", *CLASS).agg(F.sum("n").alias("n"), F.min(F.struct("row", "pos", "a", "b")).alias("one")), "kinds")
    many = kinds.filter("n > 1").select("key", *CLASS)
    whole = whole.unionByName(mixed.join(many, ["key", *CLASS]).select(*span))
    ships = kinds.select("key", "one.*", (F.col("n") == 1).alias("single"))
    crowded = stored(kinds.groupBy("key").count().filter(F.col("count") > most).select("key"), "crowded")
    spans = [whole]
    if not crowded.isEmpty():
        hot = stored(_contents(rows, ships.join(crowded, "key"), length, coded), "hot")
        spans += _refined(hot, length, most)
        drop_stored(hot)
        ships = ships.join(crowded, "key", "left_anti")
    spans.append(_compared(_contents(rows, ships, length, coded), length))
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    out.read_from = [cells, kinds, crowded]
    return out


def _stored_spans(rows: DataFrame, length: int, most: int, coded: Callable) -> DataFrame:
    """As repeated_spans(), in a table; what it was made from is deleted, so that a second search needs no more disk."""
    spans = repeated_spans(rows, length, most=most, coded=coded)
    out = stored(spans, "spans")
    drop_stored(*spans.read_from)
    return out


def _merged(own: list | None, n: int) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    for s in own or []:
        spans += [(s["lo"], s["hi"])] if s["more"] is None else map(tuple, np.frombuffer(s["more"], "<i8").reshape(-1, 2).tolist())
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, min(hi, n)) for lo, hi in out]


def _spans(rows: DataFrame, length: int, most: int) -> DataFrame:
    """row, spans; a document has at most as many spans as anchors."""
    return repeated_spans(rows, length, most=most).groupBy("row").agg(F.collect_list(F.struct("lo", "hi", "more")).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, words: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated_words, kept (bytes), row (a number of its own) of every document.

    n_repeated_words: words inside a string of ``words`` words that also starts
    elsewhere, same document included. Nothing is removed for that.
    """

    def run(batches):
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeated_words", "kept", "row"]
        for batch in batches:
            ends, whole = text_bytes(batch.column(2))
            out = []
            for row, doc_id, x, y, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), batch.column(3)):
                data, own = whole[x:y].tobytes(), own.as_py() or []
                gone = _merged([s for s in own if not s["in_words"]], len(data))
                at, kept = 0, []
                for lo, hi in gone:
                    kept.append(data[at:lo])
                    at = hi
                kept.append(data[at:])
                left = b"".join(kept)
                # Whole words: the digests beside a passage may share bytes by chance.
                n = sum(hi // WORD_BYTES - -(-lo // WORD_BYTES) for lo, hi in _merged([s for s in own if s["in_words"]], 1 << 62))
                out.append((doc_id, len(data), len(data) - len(left), len(gone), hashlib.sha256(left).hexdigest(), n, left, row))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    rows = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")))
    in_bytes = _stored_spans(rows, length, most, plain_bytes).withColumn("in_words", F.lit(False))
    in_words = _stored_spans(rows, words * WORD_BYTES, most, coded_words).withColumn("in_words", F.lit(True))
    spans = in_bytes.unionByName(in_words).groupBy("row").agg(F.collect_list(F.struct("lo", "hi", "more", "in_words")).alias("spans"))
    joined = rows.join(spans, "row", "left").select("row", "doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_repeated_words long, kept binary, row long")


def whole_characters(data: bytes, lo: int, hi: int) -> tuple[int, int]:
    """The span shrunk to whole UTF-8 characters."""
    while lo < hi and lo < len(data) and data[lo] & 0xC0 == 0x80:
        lo += 1
    while hi > lo and hi < len(data) and data[hi] & 0xC0 == 0x80:
        hi -= 1
    return lo, hi


def without_repeats(docs: DataFrame, length: int = LENGTH, text_col: str = "text", most: int = MOST) -> DataFrame:
    """The rows of ``docs``, all columns, with what repeats cut out of their texts; rows left without text go.

    Texts that were null or empty before stay as they were. Cuts keep characters
    whole; ``n_chars``, where there is one, follows a text that is cut.
    """
    name = free_name(docs, "row")
    whole = numbered(docs, name)
    spans = _spans(whole.select(F.col(name).alias("row"), text_of(text_col).alias("text")), length, most)
    gone = free_name(docs, "spans")
    joined = whole.join(spans.select(F.col("row").alias(name), F.col("spans").alias(gone)), name, "left").select(*columns_of(docs), gone)
    names = docs.columns
    at, counted = names.index(text_col), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for batch in batches:
            columns = list(batch.columns[:-1])
            text, own = columns[at], batch.column(len(columns))
            cut = np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False))
            if not len(cut):
                yield pa.RecordBatch.from_arrays(columns, names=names)
                continue
            texts, keep = text.to_pylist(), np.ones(len(batch), bool)
            sizes = columns[counted].to_pylist() if counted is not None else None
            for i in cut.tolist():
                data = texts[i].encode("utf-8", "surrogatepass")
                place, kept = 0, []
                for lo, hi in _merged(own[i].as_py(), len(data)):
                    lo, hi = whole_characters(data, lo, hi)
                    kept.append(data[place:lo])
                    place = max(place, hi)
                texts[i] = b"".join([*kept, data[place:]]).decode("utf-8", "replace")
                keep[i] = texts[i] != ""
                if sizes is not None:
                    sizes[i] = len(texts[i])
            columns[at] = pa.array(texts, text.type)
            if sizes is not None:
                columns[counted] = pa.array(sizes, columns[counted].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return joined.mapInArrow(run, docs.schema)
