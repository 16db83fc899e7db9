"""Toxicity: a factorization machine over hashed terms.

A text is its set of terms: words in lower case, and the beginnings and ends of
words, hashed. The machine scores a set by a weight for each term and a weight
for each pair of terms, the inner product of both terms' factors; so a pair such
as an insult with the mention of a group counts beyond its two words.

Fitting uses a bounded sample of labelled rows (TRAIN_ROWS, chosen by hash of
the id). Terms are first chosen by their chi-square on that sample, on the
executors; only the chosen terms of the sample come to the driver. The model has
at most TERMS * (FACTORS + 1) numbers, so it may be broadcast.

Labels, language, source and id never enter a score. A label is used for fitting
only where crc32 of the id's decimal text, modulo 3, is not 1.

Defined results: null and empty texts get the score of the empty set; null ids
count as not held out; a text with one id twice is scored twice; without any
label the score is 0.5 and nothing is predicted; rows labelled twice count once,
as toxic if either says so; of several texts with one id one is learnt from;
an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import settle, text_of

#: Labelled rows used for fitting, at most.
TRAIN_ROWS = 20_000
#: Hashed terms, and those of them that the machine may use.
SPACE = 1 << 22
TERMS = 4096
#: A term must be in so many texts of the sample.
LEAST_TEXTS = 4
FACTORS = 8
EPOCHS = 30
THRESHOLD = 0.7
#: Words whose terms a worker remembers.
CACHE = 150_000

words_of = re.compile(r"[^\W_]+").findall


def word_terms(word: str) -> set[int]:
    """The hashed terms of one word."""
    forms = [f"={word}"]
    if len(word) > 3:
        forms += [f"^{word[:k]}" for k in range(3, min(8, len(word)))] + [f"{word[-k:]}$" for k in range(3, min(7, len(word)))]
    return {zlib.crc32(f.encode("utf-8", "replace")) % SPACE for f in forms}


def text_terms(text: str) -> set[int]:
    out: set[int] = set()
    for w in set(words_of(text.lower())):
        out |= word_terms(w)
    return out


@dataclass
class Machine:
    """terms: chosen hashes, ascending. bias, weights, factors as usual."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margin(self, x: list[int]) -> float:
        """Of a set of positions in ``terms``."""
        if not x:
            return self.bias
        v = self.factors[x]
        s = v.sum(axis=0)
        return self.bias + float(self.weights[x].sum() + 0.5 * (s @ s - (v * v).sum()))


def fit(terms: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = 7) -> Machine:
    """Logistic loss, AdaGrad, one pass after another over shuffled rows in small batches."""
    rng = np.random.default_rng(seed)
    n = len(terms)
    w, v, bias = np.zeros(n), rng.normal(0, 0.05, (n, factors)), 0.0
    if len(labels) and 0 < labels.sum() < len(labels):
        bias = float(np.log(labels.mean() / (1 - labels.mean())))
    gw, gv, gb = np.full(n, 1e-6), np.full((n, factors), 1e-6), 1e-6
    rate, decay, batch = 0.15, 2e-4, 128
    for _ in range(epochs if len(rows) else 0):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            xs = [rows[i] for i in pick]
            sizes = np.array([len(x) for x in xs])
            x = np.concatenate(xs)
            row = np.repeat(np.arange(len(pick)), sizes)
            sums = np.zeros((len(pick), factors))
            np.add.at(sums, row, v[x])
            squares = np.bincount(row, weights=(v[x] ** 2).sum(axis=1), minlength=len(pick))
            z = bias + np.bincount(row, weights=w[x], minlength=len(pick)) + 0.5 * ((sums**2).sum(axis=1) - squares)
            err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]
            used, inv = np.unique(x, return_inverse=True)
            dw = np.bincount(inv, weights=err[row], minlength=len(used)) / len(pick) + decay * w[used]
            dv = np.zeros((len(used), factors))
            np.add.at(dv, inv, err[row][:, None] * (sums[row] - v[x]))
            dv = dv / len(pick) + decay * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            gb += err.mean() ** 2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate * dv / np.sqrt(gv[used])
            bias -= rate * float(err.mean()) / np.sqrt(gb)
    return Machine(terms, bias, w, v)


def held_out(id_col: str | Column) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    spark = docs.sparkSession
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    # At most ``rows`` ids with a label each: small enough to broadcast.
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    sample = docs.join(F.broadcast(chosen), F.col(id_col) == F.col("_id")).select(F.col("_id").alias("id"), F.col("_y").alias("y"), text_of(text_col).alias("text"))
    # One text for each id, that of the smallest hash: repeated rows do not weigh more, and ``rows`` bounds what the driver gets.
    first = F.min(F.struct(F.xxhash64("text"), F.col("text"))).alias("_t")
    sample = settle(sample.groupBy("id", "y").agg(first).select("id", "y", F.col("_t.text").alias("text")))

    def count(batches):
        both = np.zeros((2, SPACE), np.int32)
        n = np.zeros(2, np.int64)
        for batch in batches:
            for y, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                x = np.fromiter(text_terms(text), np.int64)
                both[y, x] += 1
                n[y] += 1
        full = np.flatnonzero(both.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(full, -1)), pa.array(np.append(both[0, full], n[0]), pa.int64()), pa.array(np.append(both[1, full], n[1]), pa.int64())], names=["term", "n0", "n1"])

    sums = settle(sample.mapInArrow(count, "term long, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    whole = sums.filter("term = -1").first()
    if whole is None or not whole["n0"] or not whole["n1"]:
        bias = 0.0 if whole is None or whole["n0"] + whole["n1"] == 0 else (-4.0 if whole["n0"] else 4.0)
        return Machine(np.zeros(0, np.int64), bias, np.zeros(0), np.zeros((0, FACTORS)))
    a, b = F.lit(float(whole["n0"])), F.lit(float(whole["n1"]))
    x, y = F.col("n0").cast("double"), F.col("n1").cast("double")
    n = a + b
    chi = n * F.pow(y * (a - x) - x * (b - y), 2) / ((x + y) * (n - x - y) * a * b)
    top = sums.filter((F.col("term") >= 0) & (F.col("n0") + F.col("n1") >= LEAST_TEXTS) & (F.col("n0") + F.col("n1") < n)).orderBy(chi.desc(), "term").limit(TERMS)
    terms = np.sort(np.array([r[0] for r in top.select("term").collect()], np.int64))
    sent = spark.sparkContext.broadcast(terms)

    def pick(batches):
        terms = sent.value
        for batch in batches:
            out = []
            for text in batch.column(2).to_pylist():
                x = np.fromiter(text_terms(text), np.int64)
                at = np.searchsorted(terms, x)
                at = at[(at < len(terms)) & (terms[np.minimum(at, len(terms) - 1)] == x)]
                out.append(np.sort(at).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["id", "y", "x"])

    got = sample.mapInArrow(pick, "id long, y int, x binary").toPandas().sort_values("id")
    return fit(terms, [np.frombuffer(r, "<i4").astype(np.int64) for r in got.x], got.y.to_numpy(np.float64))


def _scorer(model: Machine):
    """A function from a text to its score; it remembers the terms of words."""
    at = {int(t): k for k, t in enumerate(model.terms)}
    known: dict[str, tuple] = {}

    def score_of(text: str) -> float:
        x: set[int] = set()
        for w in set(words_of(text.lower())):
            t = known.get(w)
            if t is None:
                if len(known) > CACHE:
                    known.clear()
                t = tuple(at[h] for h in word_terms(w) if h in at)
                if len(w) <= 64:
                    known[w] = t
            if t:
                x.update(t)
        z = model.margin(sorted(x))
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))

    return score_of


def score(docs: DataFrame, model: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` would not fit a contract: doc_id, held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score_of = _scorer(sent.value)
        for batch in batches:
            out = [score_of(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64()), pa.array([int(s >= THRESHOLD) for s in out], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def without_toxic(docs: DataFrame, model: Machine, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text stays under the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        score_of = _scorer(sent.value)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            keep = [score_of(t or "") < THRESHOLD for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
