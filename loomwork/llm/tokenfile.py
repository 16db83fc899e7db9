"""Token ids as files: canonical length-limited Huffman codes over global counts.

A first pass tokenises every text once and stores the ids; their counts over the
whole corpus give one code. A second pass codes each document on a byte boundary
of its own, deals documents to files by range of doc_id and writes the files
through Spark's own writer, so any store that Spark reaches will do. Blocks of
BLOCK ids have their bit offsets stored and are decoded on their own, all blocks
of a segment in step, by table lookup.

File format, little endian. A file is a run of records, each: 4-byte tag, u64
length of the rest, the rest, one line feed. ``HUFC`` holds the code lengths,
one byte an id. ``HUFS`` is a segment: u64 start (ids before it), u32 documents,
u32 blocks, then for the documents i64 doc_id, u8 null flag, u64 ids; for the
blocks u64 bit offset; then the bits.

Files are parts of the order by doc_id. There are MOST_PARTS bounds between them
at most, however large the corpus; an id that holds more than a part's share is
dealt to several by its texts' hash, and a part is cut into files of a bounded
number of segments.

Defined results: null and empty texts have only the end id; null doc_ids come
first; equal doc_ids follow each other, ordered by their text's hash; texts of
any length are whole; an empty table gives no rows; other columns are not used.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import drop_stored, n_partitions, scratch, stored

END_ID = 2
SPECIAL = "<|endoftext|>"
#: Longest code in bits; the decoding table has 2^MAX_BITS entries.
MAX_BITS = 18
BLOCK = 512
#: Ids to a segment, segments to a file, and ids to a part, about.
SEGMENT_IDS = 1 << 20
FILE_SEGMENTS = 16
PART_IDS = 12_000_000
#: Parts at most: the table of their bounds goes to every task.
MOST_PARTS = 1 << 16
#: Null ids are ordered as the least number.
LEAST = -(1 << 63)


# --- tokens -------------------------------------------------------------------

#: Characters whose class is the same in every Unicode version in use; other texts take the general way.
PLAIN = re.compile("[\t\n\r\x0b\x0c -~¡-¬®-ɏ–-•…€]*")


class ByteTokenizer:
    """The ids of the tokenizers library; plain texts take a faster path over the same ranks.

    Both give the same ids (the tests compare them); the library alone takes four times as long.
    """

    def __init__(self, json_file: str, ranks_file: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.general = Tokenizer.from_file(json_file)
        self.fast = None
        if ranks_file:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_file, "rb"))}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if self.fast and SPECIAL not in text and PLAIN.fullmatch(text):
            return self.fast.encode_ordinary(text)
        return self.general.encode(text, add_special_tokens=False).ids


_tokenizers: dict = {}


def byte_tokenizer(json_file: str | None = None) -> ByteTokenizer:
    if json_file not in _tokenizers:
        import public_tokenizers as P

        if json_file is None:
            _tokenizers[json_file] = ByteTokenizer(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
        else:
            _tokenizers[json_file] = ByteTokenizer(json_file, None, None)
    return _tokenizers[json_file]


# --- codes --------------------------------------------------------------------


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Length of each id's code by package-merge; 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        out[used] = 1
        return out
    if len(used) > 1 << max_bits:
        raise ValueError("more ids than codes of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    levels = []
    merged, leaf = weights, np.ones(len(weights), bool)
    levels.append(leaf)
    for _ in range(max_bits - 1):
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
        both = np.concatenate([weights, packages])
        at = np.argsort(both, kind="stable")
        merged, leaf = both[at], at < len(weights)
        levels.append(leaf)
    depth = np.zeros(len(weights), np.int64)
    take = 2 * (len(weights) - 1)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        depth[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = depth
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), as numbers of ``lengths`` bits."""
    codes = np.zeros(len(lengths), np.uint32)
    code, before = 0, 0
    used = np.flatnonzero(lengths)
    for i in used[np.lexsort((used, lengths[used]))]:
        n = int(lengths[i])
        code <<= n - before
        codes[i], before = code, n
        code += 1
    return codes


def decoding_table(lengths: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """For every MAX_BITS bits: the id they start with << 8 | its length."""
    codes = canonical_codes(lengths)
    used = np.flatnonzero(lengths)
    used = used[np.argsort(codes[used].astype(np.uint64) << (max_bits - lengths[used].astype(np.uint64)))]
    entries = (used.astype(np.uint32) << 8) | lengths[used]
    table = np.repeat(entries, 1 << (max_bits - lengths[used].astype(np.int64)))
    return np.concatenate([table, np.zeros((1 << max_bits) - len(table), np.uint32)])


def pack(ids: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, codes: np.ndarray):
    """(bytes, byte starts of documents with the end, bit offsets of blocks, blocks of each document)."""
    n_bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(n_bits)
    first = np.concatenate([[0], np.cumsum(sizes)])
    upto = np.concatenate([[0], ends])
    doc_bits = upto[first[1:]] - upto[first[:-1]]
    starts = np.concatenate([[0], np.cumsum((doc_bits + 7) >> 3)])
    at = (ends - n_bits) + np.repeat(8 * starts[:-1] - upto[first[:-1]], sizes)
    value = codes[ids].astype(np.uint64) << (32 - n_bits - (at & 7)).astype(np.uint64)
    byte, total = at >> 3, int(starts[-1])
    out = np.zeros(total + 4, np.float64)
    for k in range(4):
        out += np.bincount(byte + k, weights=((value >> np.uint64(24 - 8 * k)) & np.uint64(255)).astype(np.float64), minlength=total + 4)
    blocks = (sizes + BLOCK - 1) // BLOCK
    inner = np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    offsets = at[np.repeat(first[:-1], blocks) + inner * BLOCK] if len(inner) else np.zeros(0, np.int64)
    return out[:total].astype(np.uint8).tobytes(), starts, offsets, blocks


def unpack(payload: bytes, offsets: np.ndarray, counts: np.ndarray, table: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """The ids of all blocks one after the other; blocks are read in step, longest first."""
    raw = np.frombuffer(payload + b"\0\0\0\0", np.uint8).astype(np.uint32)
    word = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    order = np.argsort(-counts, kind="stable")
    pos, left = offsets[order].astype(np.int64), counts[order]
    to = (np.cumsum(counts) - counts)[order]
    out = np.zeros(int(counts.sum()), np.uint32)
    live = len(left)
    mask = np.uint32((1 << max_bits) - 1)
    for k in range(int(left[0]) if live else 0):
        while live and left[live - 1] <= k:
            live -= 1
        p = pos[:live]
        entry = table[(word[p >> 3] >> (32 - max_bits - (p & 7)).astype(np.uint32)) & mask]
        out[to[:live] + k] = entry >> 8
        pos[:live] += entry & 255
    return out


# --- files --------------------------------------------------------------------


def record(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<Q", len(body)) + body


def records(content: bytes) -> Iterator[tuple[bytes, memoryview]]:
    at, view = 0, memoryview(content)
    while at < len(content):
        (n,) = struct.unpack_from("<Q", content, at + 4)
        if at + 12 + n >= len(content) or content[at + 12 + n] != 10:
            raise ValueError("a record does not end where its length says")
        yield content[at : at + 4], view[at + 12 : at + 12 + n]
        at += 13 + n


def segment(start: int, ids, nulls, sizes, blocks, bits: bytes) -> bytes:
    head = struct.pack("<QII", start, len(ids), len(blocks))
    return record(b"HUFS", b"".join([head, np.array(ids, "<i8").tobytes(), np.array(nulls, "u1").tobytes(), np.array(sizes, "<u8").tobytes(), np.array(blocks, "<u8").tobytes(), bits]))


def read_segment(body: memoryview, table: np.ndarray):
    """(start, doc_ids, null flags, sizes, all ids)."""
    start, n, b = struct.unpack_from("<QII", body, 0)
    at = 16
    doc_ids = np.frombuffer(body, "<i8", n, at)
    nulls = np.frombuffer(body, "u1", n, at + 8 * n)
    sizes = np.frombuffer(body, "<u8", n, at + 9 * n).astype(np.int64)
    at += 17 * n
    offsets = np.frombuffer(body, "<u8", b, at).astype(np.int64)
    blocks = (sizes + BLOCK - 1) // BLOCK
    inner = np.arange(b) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    counts = np.minimum(BLOCK, np.repeat(sizes, blocks) - inner * BLOCK)
    return start, doc_ids, nulls, sizes, unpack(bytes(body[at + 8 * b :]), offsets, counts, table)


def _tokenised(docs: DataFrame, json_file: str | None, id_col: str, text_col: str) -> DataFrame:
    """Packs of documents: ids, null flags, sizes, text hashes, and all token ids, compressed."""

    def run(batches):
        import zstandard

        tok, press = byte_tokenizer(json_file), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids, texts, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a in range(0, len(ids), 256):
                coded = [np.array(tok.encode(t or "") + [END_ID], np.uint32) for t in texts[a : a + 256]]
                here = ids[a : a + 256]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([[x or 0 for x in here]], pa.list_(pa.int64())),
                        pa.array([[x is None for x in here]], pa.list_(pa.bool_())),
                        pa.array([hashes[a : a + 256]], pa.list_(pa.int64())),
                        pa.array([[len(c) for c in coded]], pa.list_(pa.int64())),
                        pa.array([press.compress(np.concatenate(coded).astype("<u2" if max(int(c.max()) for c in coded) < 65536 else "<u4").tobytes())], pa.binary()),
                    ],
                    names=["ids", "nulls", "hashes", "sizes", "tokens"],
                )

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    return cols.mapInArrow(run, "ids array<long>, nulls array<boolean>, hashes array<long>, sizes array<long>, tokens binary")


def _tokens(sizes: np.ndarray, blob: bytes) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * int(sizes.sum()) else "<u4").astype(np.int64)


def parts_of(bounds: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The part of each (id, hash) between ascending bounds. Ids that are several bounds are spread by hash, in its order."""
    lo, hi = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
    place = (hashes.astype(np.float64) + 2.0**63) / 2.0**64
    spread = lo + np.minimum((place * (hi - lo + 1)).astype(np.int64), hi - lo)
    return np.where(hi - lo > 1, spread, hi)


def write(docs: DataFrame, path: str, json_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write all ids of ``docs`` under ``path`` in ascending doc_id order."""
    spark = docs.sparkSession
    packs = stored(_tokenised(docs, json_file, id_col, text_col), "tokens")
    stats = packs.select(F.explode("sizes").alias("s")).agg(F.sum("s")).first()[0] or 0
    parts = max(1, min(MOST_PARTS, max(n_partitions(spark), -(-stats // PART_IDS))))
    wanted = [(k + 1) / parts for k in range(parts - 1)]
    order = F.zip_with("ids", "nulls", lambda i, z: F.when(z, F.lit(LEAST)).otherwise(i))
    bounds = packs.select(F.explode(order).alias("i")).agg(F.percentile_approx("i", wanted, min(100_000, max(10_000, 10 * parts)))).first()[0] if wanted and stats else []
    bounds = np.array(bounds or [], np.int64)

    def place(ids, nulls, hashes):
        return parts_of(bounds, np.where(nulls, LEAST, np.array(ids, np.int64)), np.array(hashes, np.int64))

    def count(batches):
        total, files = np.zeros(0, np.int64), np.zeros(parts, np.int64)
        for batch in batches:
            for ids, nulls, hashes, sizes, blob in zip(*[batch.column(k).to_pylist() for k in range(5)]):
                sizes = np.array(sizes, np.int64)
                c = np.bincount(_tokens(sizes, blob))
                total = np.pad(total, (0, max(0, len(c) - len(total))))
                total[: len(c)] += c
                files += np.bincount(place(ids, nulls, hashes), weights=sizes, minlength=parts).astype(np.int64)
        used, full = np.flatnonzero(total), np.flatnonzero(files)
        kind = np.concatenate([np.zeros(len(used), np.int32), np.ones(len(full), np.int32)])
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([used, full])), pa.array(np.concatenate([total[used], files[full]]))], names=["kind", "k", "n"])

    # One row for each id of the vocabulary and each part, MOST_PARTS at most.
    sums = packs.select("ids", "nulls", "hashes", "sizes", "tokens").mapInArrow(count, "kind int, k long, n long").groupBy("kind", "k").agg(F.sum("n").alias("n")).toPandas()
    tokens, files = sums[sums.kind == 0], sums[sums.kind == 1]
    counts = np.zeros(int(tokens.k.max()) + 1 if len(tokens) else 1, np.int64)
    counts[tokens.k.to_numpy(np.int64)] = tokens.n.to_numpy(np.int64)
    lengths = code_lengths(counts)
    held = np.zeros(parts, np.int64)
    held[files.k.to_numpy(np.int64)] = files.n.to_numpy(np.int64)
    base = np.cumsum(held) - held
    sent = spark.sparkContext.broadcast((lengths, canonical_codes(lengths), base))

    def encode(batches):
        lengths, codes, _ = sent.value
        for batch in batches:
            for ids, nulls, hashes, sizes, blob in zip(*[batch.column(k).to_pylist() for k in range(5)]):
                sizes = np.array(sizes, np.int64)
                bits, starts, offsets, blocks = pack(_tokens(sizes, blob), sizes, lengths, codes)
                part = place(ids, nulls, hashes)
                cut = np.cumsum(blocks)
                rel = [(offsets[c - b : c] - 8 * s).astype("<u8").tobytes() for c, b, s in zip(cut, blocks, starts)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part.astype(np.int32)), pa.array([None if z else i for i, z in zip(ids, nulls)], pa.int64()), pa.array(hashes, pa.int64()), pa.array(sizes),
                        pa.array(rel, pa.binary()), pa.array([bits[a:b] for a, b in zip(starts, starts[1:])], pa.binary()),
                    ],
                    names=["part", "doc_id", "h", "size", "blocks", "bits"],
                )

    def segments(batches):
        lengths, _, base = sent.value
        start, part, first, done = 0, None, True, 0
        ids, nulls, sizes, blocks, bits, n, at = [], [], [], [], [], 0, 0

        def flush():
            nonlocal ids, nulls, sizes, blocks, bits, n, at, start, done
            out = [segment(start, ids, nulls, sizes, np.concatenate(blocks) if blocks else [], b"".join(bits))]
            if done % FILE_SEGMENTS == 0:  # the writer begins a file here
                out.insert(0, record(b"HUFC", lengths.tobytes()))
            start, done = start + n, done + 1
            ids, nulls, sizes, blocks, bits, n, at = [], [], [], [], [], 0, 0
            return pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["r"])

        for batch in batches:
            for p, i, _, size, rel, b in zip(*[batch.column(k).to_pylist() for k in range(6)]):
                if first:
                    first, part = False, p
                    start = int(base[p])
                assert p == part
                ids.append(i or 0)
                nulls.append(i is None)
                sizes.append(size)
                blocks.append(np.frombuffer(rel, "<u8") + 8 * at)
                bits.append(b)
                n, at = n + size, at + len(b)
                if n >= SEGMENT_IDS:
                    yield flush()
        if ids:
            yield flush()

    rows = packs.mapInArrow(encode, "part int, doc_id long, h long, size long, blocks binary, bits binary")
    rows = rows.repartitionById(parts, F.col("part")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")
    out = rows.mapInArrow(segments, "r binary")
    # The text writer puts a row's bytes as they are and ends each with the line feed that the format has.
    out.select(F.col("r").cast("string").alias("value")).write.options(lineSep="\n", maxRecordsPerFile=FILE_SEGMENTS + 1).text(path)
    drop_stored(packs)


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) from the files under ``path``."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches):
        tables: dict[bytes, np.ndarray] = {}
        for batch in batches:
            for content in batch.column(0):
                table = None
                for tag, body in records(content.as_py()):
                    if tag == b"HUFC":
                        key = zlib.crc32(body).to_bytes(4, "little") + len(body).to_bytes(8, "little")
                        if key not in tables:
                            tables[key] = decoding_table(np.frombuffer(body, np.uint8))
                        table = tables[key]
                        continue
                    start, doc_ids, nulls, sizes, ids = read_segment(body, table)
                    ends = np.cumsum(sizes)
                    raw = memoryview(ids.astype("<u4").tobytes())
                    sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends - sizes, ends)]
                    columns = [pa.array(doc_ids, mask=nulls.astype(bool)), pa.array(start + ends - sizes), pa.array(sizes), pa.array(sums, pa.int64())]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in schema.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def round_trip(docs: DataFrame, json_file: str | None = None) -> DataFrame:
    """Write ``docs`` to the shared folder and read the files back."""
    path = scratch(docs.sparkSession, "ids")
    write(docs, path, json_file)
    return read(docs.sparkSession, path)
