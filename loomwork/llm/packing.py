"""Best-fit packing of documents into sequences of at most CAPACITY tokens.

Only the lengths matter for the packing, and there are at most CAPACITY of them:
the packing is worked out on the table of how many pieces have each length,
whatever the size of the corpus. Lengths above one third of the capacity are
large; no sequence holds three of them. Greedy matching pairs the largest with
the largest that still fits beside it. Smaller pieces, longest first, go to the
smallest gap that takes them, and to new sequences only when none does. All of
this moves whole runs of equal pieces into whole runs of equal sequences, and
gives what it would give piece by piece.

The outcome is a list of runs: pieces of a length, by their number among all of
that length, and the sequences and the place in them where they go. It is bounded
by the capacity, and each task looks up its own pieces in it. Pieces are numbered
by their task's part: numbers count within a part and length, and parts are added
up, so no task sees all pieces of a length.

Defined results: null and empty texts have only the end id; rows with one id or
none are documents of their own; documents beyond the capacity are cut into full
pieces and a rest; texts of any length are taken whole; which of two pieces of
one length goes where is open; an empty table gives none; other columns are not
used.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import stored

CAPACITY = 2048
END_ID = 0
#: Words whose ids a worker remembers.
CACHE_WORDS = 200_000
#: Texts encoded before their rows are handed on.
SLICE = 1024


# --- tokens -------------------------------------------------------------------

#: Characters that composing leaves alone and whose class and lower case are the same in every Unicode version in use.
PLAIN = re.compile("[\t\n\r\x0b\x0c -~¡-¬®-įı-ɏ–-•…€]*")
#: The strings that the vocabulary's file takes as one token.
SPECIAL = ("<|startoftext|>", "<|endoftext|>")


def _cutter():
    """How the vocabulary's file cuts lower-cased text, over the characters of PLAIN."""
    kinds = {c: unicodedata.category(c)[0] for c in map(chr, range(0x250)) if PLAIN.fullmatch(c)}
    letters, digits = ("".join(c for c, k in kinds.items() if k == kind) for kind in "LN")
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^\s{letters}{digits}]+").findall


def byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in the vocabulary: printable ones for themselves, the others from 256 on in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}


class WordTokenizer:
    """The ids of the tokenizers library as bytes of unsigned 32-bit integers.

    Words are encoded on their own, so the ids of each are remembered; texts with
    characters beyond PLAIN, or with a special token's string, go to the library
    whole. Both give the same ids (the tests compare them).
    """

    def __init__(self, json_file: str):
        from tokenizers import Tokenizer

        self.general, self.cut = Tokenizer.from_file(json_file), _cutter()
        model, signs, older = self.general.model.tokenize, byte_signs(), {}

        class Known(dict):
            """Ids by word. A full table becomes the older one, so words in use stay."""

            def __missing__(self, word: str) -> bytes:
                if len(self) >= CACHE_WORDS:
                    older.clear()
                    older.update(self)
                    self.clear()
                coded = older.get(word)
                if coded is None:
                    coded = pack_ids([t.id for t in model(word if word.isascii() else word.encode().decode("latin-1").translate(signs))])
                if len(word) <= 64:
                    self[word] = coded
                return coded

        self.known = Known()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if PLAIN.fullmatch(text) and not any(s in text for s in SPECIAL):
            return b"".join(map(self.known.__getitem__, self.cut(text.lower())))
        return pack_ids(self.general.encode(text, add_special_tokens=False).ids)


def pack_ids(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(json_file: str | None = None) -> WordTokenizer:
    if json_file is None:
        import public_tokenizers

        json_file = public_tokenizers.path("word_bpe_49k.json")
    if json_file not in _tokenizers:
        _tokenizers[json_file] = WordTokenizer(json_file)
    return _tokenizers[json_file]


# --- the packing of a table of lengths -----------------------------------------

#: A run: ``n`` pieces of ``length``, from number ``rank`` on, ``each`` to a sequence, in sequences from ``first`` on, from token ``at`` on.
RUN = ("length", "rank", "n", "first", "each", "at")


class _Packing:
    def __init__(self, counts: np.ndarray, capacity: int):
        self.capacity, self.left = capacity, [int(c) for c in counts]
        self.rank, self.sequences, self.runs = defaultdict(int), 0, []
        # by what is free in them: runs (first, n) of sequences
        self.free: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def put(self, length: int, n: int, first: int, each: int, at: int) -> None:
        self.runs.append((length, self.rank[length], n, first, each, at))
        self.rank[length] += n
        self.left[length] -= n

    def opened(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def gap(self, size: int, first: int, n: int) -> None:
        if n and size:
            self.free[size].append((first, n))

    def match_large(self) -> None:
        """Each large length, longest first, beside the largest that fits."""
        cap = self.capacity
        least = cap // 3 + 1
        for a in range(cap, least - 1, -1):
            b = min(a, cap - a)
            while self.left[a]:
                while b >= least and not (self.left[b] and (b < a or self.left[a] > 1)):
                    b -= 1
                if b < least:
                    n = self.left[a]
                    first = self.opened(n)
                    self.put(a, n, first, 1, 0)
                    self.gap(cap - a, first, n)
                elif b == a:
                    n = self.left[a] // 2
                    first = self.opened(n)
                    self.put(a, 2 * n, first, 2, 0)
                    self.gap(cap - 2 * a, first, n)
                else:
                    n = min(self.left[a], self.left[b])
                    first = self.opened(n)
                    self.put(a, n, first, 1, 0)
                    self.put(b, n, first, 1, a)
                    self.gap(cap - a - b, first, n)

    def fit_small(self) -> None:
        """Each smaller length, longest first, into the smallest gap that takes it.

        A sequence just filled has the smallest gap of all that still take the
        length, so best fit fills it before it turns to the next one.
        """
        cap = self.capacity
        for s in range(cap // 3, 0, -1):
            g = s
            while self.left[s]:
                while g < cap and not self.free.get(g):
                    g += 1
                if g >= cap:
                    g, n = cap, -(-self.left[s] // (cap // s))
                    first = self.opened(n)
                else:
                    first, n = self.free[g].pop()
                each = g // s
                full = min(n, self.left[s] // each)
                if full:
                    self.put(s, full * each, first, each, cap - g)
                    self.gap(g - each * s, first, full)
                rest = self.left[s] if full < n else 0
                if rest:
                    self.put(s, rest, first + full, rest, cap - g)
                    self.gap(g - rest * s, first + full, 1)
                    full += 1
                self.gap(g, first + full, n - full)


def pack_lengths(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """(runs, sequences) for ``counts[n]`` pieces of each length n from 1 to the capacity."""
    packing = _Packing(counts, capacity)
    packing.match_large()
    packing.fit_small()
    runs = np.array(packing.runs, np.int64).reshape(-1, len(RUN))
    return runs[np.lexsort((runs[:, 1], runs[:, 0]))], packing.sequences


def places(runs: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces by their length and their number among all of that length."""
    wide = np.int64(1) << np.int64(48)  # length and number as one number to search by
    run = runs[np.searchsorted(runs[:, 0] * wide + runs[:, 1], length * wide + rank, side="right") - 1]
    k = rank - run[:, 1]
    return run[:, 3] + k // run[:, 4], run[:, 5] + k % run[:, 4] * length


# --- documents -----------------------------------------------------------------

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, _part int, _rank long"


def cut_documents(docs: DataFrame, capacity: int, json_file: str | None, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """The pieces of all documents, numbered within their part and length."""
    schema = PIECE + (", ids array<int>" if with_ids else "")

    def run(batches):
        tokenizer, part = word_tokenizer(json_file), TaskContext.get().partitionId()
        end, seen = np.array([END_ID], "<u4").tobytes(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE):
                rows, ids = [], []
                for doc_id, text in zip(batch.column(0)[a : a + SLICE].to_pylist(), batch.column(1)[a : a + SLICE].to_pylist()):
                    raw = tokenizer.encode(text or "") + end
                    for k in range(0, len(raw), 4 * capacity):
                        own = raw[k : k + 4 * capacity]
                        n = len(own) // 4
                        rows.append((doc_id, k // (4 * capacity), k // 4, n, zlib.crc32(own), part, int(seen[n])))
                        seen[n] += 1
                        if with_ids:
                            ids.append(np.frombuffer(own, "<i4"))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
                if with_ids:
                    ends = np.cumsum([0] + [len(i) for i in ids]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))))
                yield pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def pack(docs: DataFrame, capacity: int = CAPACITY, json_file: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids): one row for each piece."""
    spark = docs.sparkSession
    pieces = stored(cut_documents(docs, capacity, json_file, id_col, text_col, with_ids), "pieces")
    # One row for each part and length that it has: what earlier parts have of the length comes before.
    held = stored(pieces.groupBy("_part", "length").agg(F.count("*").alias("_n")), "held")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in held.groupBy("length").agg(F.sum("_n")).collect():  # capacity rows at most
        counts[length] = n
    sent = spark.sparkContext.broadcast(pack_lengths(counts, capacity)[0])
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("_part", "length", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    rows = pieces.join(before, ["_part", "length"])
    out = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    kept = [c.split(" ")[0] for c in out.split(", ") if not c.startswith(("sequence_id", "offset"))]

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                length = batch.column("length").to_numpy()
                sequence, offset = places(sent.value, length, batch.column("_at").to_numpy())
                new = {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}
                names = [c.split(" ")[0] for c in out.split(", ")]
                yield pa.RecordBatch.from_arrays([new[c] if c in new else batch.column(c) for c in names], names=names)

    return rows.select(*kept, (F.col("_rank") + F.col("_before")).alias("_at")).mapInArrow(place, out)


def sequences(docs: DataFrame, **options) -> DataFrame:
    """sequence_id, ids, doc_ids, lengths: the packed sequences themselves, each of at most the capacity's tokens."""
    inside = pack(docs, with_ids=True, **options).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("p"))
    return inside.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))
