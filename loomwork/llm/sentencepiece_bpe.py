"""SentencePiece (merge type) encoding and decoding with a prefix table.

In a merge-type encoding the last token of every prefix is unique, and it is the
one token ending there that is compatible with the last token before it: the
pair, merged on its own, gives the same two tokens. So one pass over an
automaton's matches fills a table of last tokens, and ids are read backwards.

Text falls apart at every boundary that no piece spans (before a run of word
marks, around line ends, before most punctuation: worked out from the pieces);
parts are remembered within a bounded cache, whole texts are not.

Defined results: null and empty texts give no ids and an empty text; characters
that no piece has become their UTF-8 byte ids; very long texts and words take
memory in proportion to their length; rows are independent, so repeated rows and
clashing extra columns do no harm.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNKNOWN = 0
#: Parts that a worker remembers before it starts afresh.
CACHE = 150_000
#: Texts encoded at a time.
SLICE = 256


class PieceTable:
    """One vocabulary: automaton over its pieces, pair tests, and the table method."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = {}
        self.score: dict[str, float] = {}
        self.id_of: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.id_of[p] = i
                self.score[p] = sp.get_score(i)
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        inner = [p for p in self.id_of if MARK in p.lstrip(MARK)]
        if inner:
            raise ValueError(f"pieces span word starts: {inner[:3]}")
        self.parts_of = self._splitter()
        #: (before << 20 | token) -> whether the pair stands
        self.pairs: dict[int, bool] = {}
        self.parts: dict[str, str] = {}
        #: text of each id; bytes over 127 as lone surrogates until they are joined
        self.text_of = {}
        for i, p in enumerate(self.pieces):
            self.text_of[str(i)] = p.replace(MARK, " ")
        for b, i in self.byte_id.items():
            self.text_of[str(i)] = chr(b) if b < 128 else chr(0xDC00 + b)

    def _splitter(self):
        """findall of a pattern that cuts only where no piece has both characters side by side."""
        multi = [p for p in self.id_of if len(p) > 1]
        letter = re.compile(r"[^\W\d_]").match
        after_word = {b for p in multi for a, b in zip(p, p[1:]) if letter(a)}
        joined = {c for p in multi for c in p}
        alone = "".join(c for c in "\n\t\x0b\x0c" if c not in joined)
        stops = "".join(c for c in ".,;:!?|*%$&#()[]\"" if c not in after_word)
        # word: marks and letters; else marks and anything up to the next mark or a character that stands alone
        alone, stops = re.escape(alone), re.escape(stops)
        alone = f"[{alone}]|" if alone else ""
        ends = f"(?=[{stops}{MARK}{alone[1:-2]}]|$)" if stops else f"(?=[{MARK}{alone[1:-2]}]|$)"
        return re.compile(f"{alone}{MARK}*[^\\W\\d_]+{ends}|{MARK}*[^{MARK}{alone[1:-2]}]+|{MARK}+").findall

    def merge(self, text: str) -> list[str]:
        """The definition: join the best-scored neighbours, leftmost first, until none is a piece."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stands(self, before: int, token: int) -> bool:
        """Whether ``token`` after ``before`` (0: nothing, or no piece) stays as it is."""
        here = self.pieces[token]
        if before == UNKNOWN:
            return self.merge(here) == [here]
        return self.merge(self.pieces[before] + here) == [self.pieces[before], here]

    def encode_part(self, part: str) -> list[int]:
        n = len(part)
        #: last token of each prefix; 0: none yet, or its last character is in no piece
        last = [UNKNOWN] * (n + 1)
        pairs = self.pairs
        for end, (length, token) in self.automaton.iter(part):
            end += 1
            if last[end]:
                continue
            key = last[end - length] << 20 | token
            ok = pairs.get(key)
            if ok is None:
                ok = pairs[key] = self.stands(key >> 20, token)
            if ok:
                last[end] = token
        ids: list[int] = []
        k = n
        while k:
            token = last[k]
            if not token:
                ids += [self.byte_id[b] for b in reversed(part[k - 1].encode("utf-8", "replace"))]
                k -= 1
            else:
                ids.append(token)
                k -= len(self.pieces[token])
        return ids[::-1]

    def encode_csv(self, text: str) -> str:
        """The ids in decimal, joined by commas."""
        if not text:
            return ""
        marked = MARK + text.replace(" ", MARK)
        parts, known = self.parts_of(marked), self.parts
        try:
            return ",".join(map(known.__getitem__, parts))
        except KeyError:
            pass
        if len(known) > CACHE:
            known.clear()
        if len(self.pairs) > 2 * CACHE:
            self.pairs.clear()
        own = {}
        for p in set(parts):
            csv = known.get(p)
            if csv is None:
                csv = ",".join(map(str, self.encode_part(p)))
                if len(p) <= 64:
                    known[p] = csv
            own[p] = csv
        return ",".join([own[p] for p in parts])

    def decode_csv(self, csv: str) -> str:
        if not csv:
            return ""
        joined = "".join(map(self.text_of.__getitem__, csv.split(",")))
        # the mark that encoding put first goes again
        joined = joined[1:] if joined[:1] == " " else joined
        return joined.encode("utf-8", "surrogateescape").decode("utf-8", "replace")

    def encode(self, text: str) -> list[int]:
        csv = self.encode_csv(text)
        return [int(x) for x in csv.split(",")] if csv else []

    def decode(self, ids: list[int]) -> str:
        return self.decode_csv(",".join(map(str, ids)))


_tables: dict[str, PieceTable] = {}


def piece_table(model_file: str) -> PieceTable:
    if model_file not in _tables:
        _tables[model_file] = PieceTable(model_file)
    return _tables[model_file]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, model_file: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` also ids and decoded."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(model_file or default_model())
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                n, a, b, ids, texts = [], [], [], [], []
                for text in batch.column(1).to_pylist():
                    csv = table.encode_csv(text or "")
                    decoded = table.decode_csv(csv)
                    n.append(csv.count(",") + 1 if csv else 0)
                    a.append(hashlib.sha256(csv.encode()).hexdigest())
                    b.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if with_ids:
                        ids.append(np.array(csv.split(",") if csv else [], np.int32))
                        texts.append(decoded)
                columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                if with_ids:
                    columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
