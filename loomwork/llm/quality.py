"""Quality: perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is over symbols, ORDER at a time: all UTF-8 bytes as they are, so that
case, control bytes and any script count, and what is gathered grows with the
text; ORDER symbols make one 64-bit number, none of them folded onto another.
Order of words beyond ORDER bytes is not seen. Documents are dealt to blocks by hash of
their id, as compressed packs; an id with more text than a block is dealt to several
by hash of its texts. Each block sends the distinct grams it holds; all
counts, continuation counts and discounts are sums and joins over tables sharded
by gram, three models in one chain; and the grams' probabilities are joined back to their blocks, where
each document's perplexity is summed up. No task or driver ever holds the model.

Trusted are documents labelled quality 1. A document is kept if its perplexity is
at most its language's quantile of the trusted documents' perplexities, from the
first such document on (of all trusted ones where the language has none). For this quantile
the trusted are dealt to two halves by hash of their id, and each is scored by the
model of the other half: of a text that it was made from, a model thinks too well.

Defined results: null and empty texts have perplexity 1.0 and are kept; without
trusted documents all are kept and the threshold is null; null languages are a
language of their own; rows with one id are scored each; an empty table gives no
rows; a document of any length is scored whole; extra columns are not used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import drop_stored, settle, stored, text_bytes, text_of

ORDER = 5
#: A byte and 0, the pad, which is no byte of a text.
BITS = 9
SYMBOLS = 1 << BITS
QUANTILE = 0.99
#: Bytes of text aimed at in a block, and grams held before they are counted together.
BLOCK_BYTES = 32_000_000
HELD_GRAMS = 1 << 20
#: Ids with more text than a block, up to which their table is broadcast.
BROADCAST_IDS = 10_000
#: Counts and probabilities by the model of all trusted texts, of half 0 and of half 1.
COUNTS = ("c", "c0", "c1")
MODELS = ("p", "p0", "p1")


def grams(data: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The gram that ends at each byte; the text is preceded by pads."""
    assert order * BITS < 64
    s = np.concatenate([np.zeros(order - 1, np.int64), data.astype(np.int64) + 1])
    g = np.zeros(len(data), np.int64)
    for j in range(order):
        g |= s[j : j + len(data)] << (BITS * (order - 1 - j))
    return g


def _summed(gram: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, ascending, and the sums of n."""
    g, c = np.concatenate(gram), np.concatenate(n)
    order = np.argsort(g)
    g = g[order]
    starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    return g[starts], np.add.reduceat(c[order], starts) if len(g) else c


def _pack(docs: DataFrame, blocks: int, hot: DataFrame | None, id_col: str, text_col: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield from _packed_by_block(batch)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col("lang"), text_of(text_col).alias("text"))
    salt = F.lit(0)
    if hot is not None:
        rows = rows.join(hot.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left")
        salt = F.coalesce(F.pmod(F.xxhash64("text"), F.col("parts")), F.lit(0))
    # rows without an id are never trusted: they are dealt by their text
    block = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("int")).otherwise(_block(F.col("doc_id"), salt, blocks))
    return rows.select(block.alias("block"), "doc_id", "lang", "text").mapInArrow(run, PACKED)


PACKED = "block int, pack binary"


def _packed_by_block(batch: pa.RecordBatch):
    """A batch whose first column is the block, as one compressed pack of the other columns for each block."""
    import zstandard

    press = zstandard.ZstdCompressor(level=6)
    block = batch.column(0).to_numpy()
    order = np.argsort(block, kind="stable")
    cuts = np.flatnonzero(np.diff(block[order])) + 1
    out: list[list] = [[], []]
    for at in np.split(order, cuts) if len(order) else []:
        part = batch.take(pa.array(at)).select(list(range(1, batch.num_columns)))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, part.schema) as writer:
            writer.write_batch(part)
        out[0].append(int(block[at[0]]))
        out[1].append(press.compress(sink.getvalue().to_pybytes()))
    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], names=["block", "pack"])


def _unpacked(packs: pa.ChunkedArray):
    """The batches of packs."""
    import zstandard

    raw = zstandard.ZstdDecompressor()
    for pack in packs:
        yield from pa.ipc.open_stream(raw.decompress(pack.as_py()))


def _block(doc_id: Column, salt: Column, blocks: int) -> Column:
    """The block of an id; an id with much text has several salts."""
    first = F.xxhash64(doc_id)
    return F.pmod(F.when(salt == 0, first).otherwise(F.xxhash64(first, salt.cast("long"))), F.lit(blocks)).cast("int")


def _hot_ids(sizes: DataFrame) -> DataFrame:
    """doc_id, parts: ids with more text than a block, and how many blocks their rows are dealt to; at most one for each block."""
    hot = settle(sizes.filter((F.col("n") > BLOCK_BYTES) & F.col("doc_id").isNotNull()).select("doc_id", F.ceil(2 * F.col("n") / BLOCK_BYTES).alias("parts")))
    return F.broadcast(hot) if hot.count() <= BROADCAST_IDS else hot


def _documents(table: pa.Table):
    """doc_id, lang, bytes of every document in a block's packs."""
    for batch in _unpacked(table.column("pack")):
        ends, data = text_bytes(batch.column(2))
        for i, (doc_id, lang) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            yield doc_id, lang, data[ends[i] : ends[i + 1]]


def _block_grams(packs: DataFrame, trusted: DataFrame, order: int) -> DataFrame:
    """block, gram, n, n1: the distinct grams of a block and how often its trusted documents, and those of half 1, have them."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        ids = dict(zip(right.column("doc_id").to_pylist(), right.column("half").to_pylist()))
        none = np.zeros((0, 2), np.int64)
        g, n = [none[:, 0]], [none]
        held = 0
        for doc_id, _, data in _documents(left):
            own, c = np.unique(grams(data, order), return_counts=True)
            g.append(own)
            half = ids.get(doc_id)
            n.append(np.outer(c, [half is not None, half == 1]).astype(np.int64))
            held += len(own)
            if held >= HELD_GRAMS:
                one = _summed(g, n)
                g, n, held = [one[0]], [one[1]], 0
        at, n = _summed(g, n)
        return pa.table({"block": pa.array(np.full(len(at), key[0].as_py(), np.int32)), "gram": pa.array(at), "n": pa.array(n[:, 0]), "n1": pa.array(n[:, 1])})

    return packs.groupBy("block").cogroup(trusted.groupBy("block")).applyInArrow(run, "block int, gram long, n long, n1 long")


def discounts(counts: DataFrame) -> list[tuple[float, float, float]]:
    """D1, D2, D3+ of one order for each model, from the numbers of grams seen 1 to 4 times."""
    got = counts.agg(*[F.count_if(F.col(c) == k).alias(f"{c}_{k}") for c in COUNTS for k in (1, 2, 3, 4)]).first()
    out = []
    for c in COUNTS:
        n1, n2, n3, n4 = (max(1, got[f"{c}_{k}"]) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        out.append(tuple(min(k, max(0.05, k - (k + 1) * y * b / a)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))))
    return out


def probabilities(counts: DataFrame, wanted: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, p, p0, p1 for the grams of ``wanted``, a stored table without repeats.

    ``counts``, stored: gram and its counts in all trusted texts, in those of half
    0 and of half 1. The three models go through one chain of joins. A half's
    model is asked for grams of the other half only; p0 and p1 are null elsewhere.

    Order by order from below: a gram's discounted share of its context plus what
    the context gives away times the probability one order lower. Lower orders
    count how many symbols come before a gram, not how often it occurs.
    """
    levels = [counts]
    for k in range(order - 1, 0, -1):
        seen = levels[-1].select(F.expr(f"gram & {SYMBOLS**k - 1}").alias("gram"), *COUNTS)
        levels.append(stored(seen.groupBy("gram").agg(*[F.count_if(F.col(c) > 0).alias(c) for c in COUNTS]), "level"))
    lower = None
    for k, level in enumerate(levels[::-1], 1):
        ask = wanted.select(F.expr(f"gram & {SYMBOLS**k - 1}").alias("gram")).distinct() if k < order else wanted
        cuts = [F.when(F.col(c) == 1, d1).when(F.col(c) == 2, d2).when(F.col(c) > 2, d3).otherwise(0.0) for c, (d1, d2, d3) in zip(COUNTS, discounts(level))]
        context = F.shiftright("gram", BITS)
        sums = [x for c, cut in zip(COUNTS, cuts) for x in (F.sum(c).alias(f"total_{c}"), F.sum(cut).alias(f"given_{c}"))]
        whole = level.groupBy(context.alias("context")).agg(*sums)
        rows = ask.join(level, "gram", "left").withColumn("context", context).join(whole, "context", "left")
        if lower is not None:
            below = lower.select(F.col("gram").alias("_b"), *[F.col(p).alias(f"_{p}") for p in MODELS])
            rows = rows.withColumn("_b", F.expr(f"gram & {SYMBOLS ** (k - 1) - 1}")).join(below, "_b")
        out = []
        for p, c, cut, asked in zip(MODELS, COUNTS, cuts, (None, "c1", "c0")):
            q = F.lit(1.0 / SYMBOLS) if lower is None else F.col(f"_{p}")
            own = F.when(F.col(c) > 0, (F.col(c) - cut) / F.col(f"total_{c}")).otherwise(0.0)
            value = F.when(F.coalesce(f"total_{c}", F.lit(0)) == 0, q).otherwise(own + F.col(f"given_{c}") / F.col(f"total_{c}") * q)
            out.append((value if asked is None else F.when(F.col(asked) > 0, value)).alias(p))
        before, lower = lower, stored(rows.select("gram", *out), "p")
        drop_stored(before, level)
    return lower


def _answers(held: DataFrame, p: DataFrame) -> DataFrame:
    """block, pack: the grams of each block with their probabilities, those of a half's model where the block asks for them."""

    def run(batches):
        for batch in batches:
            yield from _packed_by_block(batch)

    # one number for block and questions: what is sent is a row for each gram of each block
    asks = held.select("gram", F.expr("block * 4L + IF(n1 > 0, 1, 0) + IF(n > n1, 2, 0)").alias("_ask"))
    half = lambda k, bit: F.when(F.col("_ask").bitwiseAND(F.lit(bit)) > 0, F.col(k)).cast("float").alias(k)
    rows = asks.join(p, "gram").select(F.shiftright("_ask", 2).cast("int").alias("block"), "gram", F.col("p").cast("float").alias("p"), half("p0", 1), half("p1", 2))
    return rows.mapInArrow(run, PACKED)


def _scores(packs: DataFrame, answers: DataFrame, order: int) -> DataFrame:
    names = ["perplexity", "by_0", "by_1"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = list(_unpacked(right.column("pack")))
        none = [np.zeros(0, np.int64)]
        known = np.concatenate(none + [x.column(0).to_numpy() for x in parts])
        by = np.argsort(known)
        known = known[by]
        # Seven digits of a probability do; what was not asked for is null, here not a number
        logp = [np.log(np.concatenate(none + [x.column(k).to_numpy(zero_copy_only=False) for x in parts])[by].astype(np.float64)) for k in (1, 2, 3)]
        ids, langs, sizes = [], [], []
        ppl: list[list] = [[], [], []]
        for doc_id, lang, data in _documents(left):
            ids.append(doc_id)
            langs.append(lang)
            sizes.append(len(data))
            g, n = np.unique(grams(data, order), return_counts=True)
            at = np.searchsorted(known, g)
            for column, x in zip(ppl, logp):
                column.append(float(np.exp(-(x[at] * n).sum() / len(data))) if len(data) else 1.0)
        columns = {k: pa.array(v, pa.float64()) for k, v in zip(names, ppl)}
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "lang": pa.array(langs, pa.string()), "n_bytes": pa.array(sizes, pa.int64())} | columns)

    return packs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, "doc_id long, lang string, n_bytes long, perplexity double, by_0 double, by_1 double")


def _half(c: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), c.cast("long")), F.lit(2)).cast("int").alias("half")


def _all_perplexities(docs: DataFrame, trusted_ids: DataFrame, order: int, id_col: str, text_col: str) -> DataFrame:
    """As perplexities(), with by_0 and by_1 under the models of either half; these are of trusted documents of the other one only."""
    sizes = docs.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.sum(F.octet_length(text_of(text_col))).alias("n"))
    size, largest = sizes.agg(F.sum("n"), F.max(F.when(F.col("doc_id").isNotNull(), F.col("n")))).first()
    blocks = max(1, -(-(size or 0) // BLOCK_BYTES))
    hot = _hot_ids(sizes) if (largest or 0) > BLOCK_BYTES else None
    packs = _pack(docs, blocks, hot, id_col, text_col)
    trusted = trusted_ids.select(F.col("doc_id").cast("long").alias("doc_id"), _half(F.col("doc_id")))
    salt = F.lit(0)
    if hot is not None:
        trusted = trusted.join(hot, "doc_id", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("parts"), F.lit(1)) - 1)))
        salt = F.col("salt")
    # two salts of an id may meet in one block
    trusted = trusted.select(_block(F.col("doc_id"), salt, blocks).alias("block"), "doc_id", "half").distinct()
    held = stored(_block_grams(packs, trusted, order), "grams")
    trusted_grams = held.filter("n > 0").groupBy("gram").agg(F.sum("n").alias("c"), F.sum("n1").alias("c1"))
    counts = stored(trusted_grams.select("gram", "c", (F.col("c") - F.col("c1")).alias("c0"), "c1"), "counts")
    wanted = stored(held.select("gram").distinct(), "wanted")
    p = probabilities(counts, wanted, order)
    drop_stored(wanted)
    # A table of its own, so that texts and grams need not lie in scratch space at one time.
    answers = stored(_answers(held, p), "answers")
    drop_stored(held, p)
    out = settle(_scores(packs, answers, order))
    drop_stored(answers)
    return out


def perplexities(docs: DataFrame, trusted_ids: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang, n_bytes, perplexity of every row; trusted_ids: doc_id, distinct."""
    return _all_perplexities(docs, trusted_ids, order, id_col, text_col).drop("by_0", "by_1")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, order: int = ORDER) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold, keep."""
    trusted = settle(labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct())
    scored = _all_perplexities(docs, trusted, order, "doc_id", "text")
    known = scored.join(trusted, "doc_id", "left_semi").filter("n_bytes > 0").withColumn("perplexity", F.when(_half(F.col("doc_id")) == 0, F.col("by_1")).otherwise(F.col("by_0")))
    # Sketches of quantiles merge, so a language may hold any share of the rows.
    limits = settle(known.groupBy(F.col("lang").alias("_lang")).agg(F.percentile_approx("perplexity", quantile, 10_000).alias("threshold")))
    whole = known.agg(F.percentile_approx("perplexity", quantile, 10_000).alias("all"))
    rest = whole.first()[0]
    rows = scored.join(limits, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    threshold = F.coalesce("threshold", F.lit(rest).cast("double"))
    keep = F.coalesce((F.col("perplexity") <= threshold) | (F.col("n_bytes") == 0), F.lit(True))
    return rows.select("doc_id", "lang", "n_bytes", "perplexity", threshold.alias("threshold"), keep.alias("keep"))
