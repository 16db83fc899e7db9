"""Document fingerprints: a homomorphic multiset hash of a text's passages.

Each passage is hashed to a wide vector and a text's fingerprint is the sum of
its passages' vectors, modulo powers of two. Sums do not depend on order, and a
passage is inserted or deleted by adding or subtracting its vector: added() and
removed() do so on fingerprints alone. The vector has three parts: the number of
passages; strong lanes, whole hashes modulo 2^32, that tell unequal multisets
apart; and counting lanes, one hash bit each, modulo 2^20, whose deviation from
the mean gives the likeness of two texts (the cosine of the two sums of random
signs estimates how large a share of passages both have).

While they are summed, counting lanes lie 32 bits apart, two to a number. A text
has under 2^31 bytes and so fewer passages: no lane can run into the next one.

Passages are parts of paragraphs, a few words each: every paragraph, short or
long, is cut at content-defined places: after punctuation, and after words that
end in a digit, one of a few fixed letters or a letter beyond ASCII. Half of the
texts tried have at most six lines, a sixth at most two: few parts for a likeness.

Only DataFrame functions run here. One shuffle brings texts together by range of
doc_id; passages are summed in the same stage. Ranges with many rows, such as
those of an id that is repeated or missing, are cut on by their texts' hashes.

Defined results: null and empty texts are the same empty multiset; two empty
ones are alike (1.0), an empty and a full one are not (0.0); rows with one id are
taken in order of their text's hash; null ids come last; one document alone is
its own next; an empty table gives an empty one; other columns are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import settle, text_of

#: Where passages end.
CUT = r"(?<=[\n.,;:!?|*%$&#])\s*|(?<=[0-9dkmstyzDKMSTYZ\x80-\uFFFF])\s+"
#: Counting lanes: 2 hashes x 60 bits, two lanes to each sum while they are summed.
SEEDS = (11, 23)
SUMS = 30
LANE = 0x0000000100000001
LANES = len(SEEDS) * SUMS * 2
MASK20 = (1 << 20) - 1
#: Strong lanes, modulo 2^32.
STRONG = (37, 41, 43, 47)
#: 2^6 consecutive ids are handled together; those of a range with more rows than HOT_RANGE in cells of about CELL_ROWS.
BUCKET_BITS = 6
HOT_RANGE = 4096
CELL_ROWS = 256
#: Ranges that are cut on, up to which their table is broadcast.
BROADCAST_RANGES = 10_000


def passages(text: Column) -> Column:
    return F.filter(F.split(text_of(text), CUT), lambda p: p != "")


def lane_columns() -> list[str]:
    return [f"c{s}_{k}" for s in range(len(SEEDS)) for k in range(SUMS)] + [f"s{k}" for k in range(len(STRONG))]


def lane_sums(passage: Column) -> list[Column]:
    """The aggregates that add up the vectors of passages; an empty passage adds nothing."""
    full = passage != ""
    out = [F.sum(full.cast("long")).alias("n")]
    for s, seed in enumerate(SEEDS):
        h = F.when(full, F.xxhash64(passage, F.lit(seed))).otherwise(F.lit(0))
        out += [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(LANE))).alias(f"c{s}_{k}") for k in range(SUMS)]
    for k, seed in enumerate(STRONG):
        h = F.when(full, F.xxhash64(passage, F.lit(seed))).otherwise(F.lit(0))
        out.append(F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"s{k}"))
    return out


#: The parts of a fingerprint's text, in hex: passages (16 digits), counting lanes three at a time (15), strong lanes (8).
THREES = LANES // 3
AT_LANES, AT_STRONG = 17, 17 + 15 * THREES


def _hexed(n: Column, lanes: list[Column], strong: list[Column]) -> Column:
    digits = lambda x, k: F.lpad(F.lower(F.hex(x)), k, "0")
    threes = [lanes[i].bitwiseOR(F.shiftleft(lanes[i + 1], 20)).bitwiseOR(F.shiftleft(lanes[i + 2], 40)) for i in range(0, LANES, 3)]
    return F.concat(digits(n, 16), *[digits(x, 15) for x in threes], *[digits(x, 8) for x in strong])


def fingerprint_string() -> Column:
    """Hex of the passages' number and all lanes, from the columns of lane_sums()."""
    packed = [F.coalesce(F.col(f"c{s}_{k}"), F.lit(0)) for s in range(len(SEEDS)) for k in range(SUMS)]
    lanes = [x.bitwiseAND(F.lit(MASK20)) for c in packed for x in (c, F.shiftrightunsigned(c, 32))]
    strong = [F.coalesce(F.col(f"s{k}"), F.lit(0)).bitwiseAND(F.lit(0xFFFFFFFF)) for k in range(len(STRONG))]
    return _hexed(F.coalesce(F.col("n"), F.lit(0)), lanes, strong)


def _number(fp: Column, at: int | Column, digits: int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substring(fp, at, F.lit(digits)), 16, 10).cast("long")


def passage_count(fp: Column) -> Column:
    """How many passages a fingerprint sums up."""
    return _number(fp, 1, 16)


def signs(fp: Column) -> Column:
    """The counting lanes of a fingerprint as an array of counts."""
    packed = F.transform(F.sequence(F.lit(0), F.lit(THREES - 1)), lambda i: _number(fp, i * 15 + AT_LANES, 15))
    return F.flatten(F.transform(packed, lambda x: F.array(*[F.shiftrightunsigned(x, 20 * j).bitwiseAND(F.lit(MASK20)) for j in range(3)])))


def _combined(a: Column, b: Column, sign: int) -> Column:
    def both(x: Column, y: Column, mask: int) -> Column:
        return (x + sign * y).bitwiseAND(F.lit(mask))

    def three(lanes: Column, i: Column) -> Column:
        return lanes[3 * i].bitwiseOR(F.shiftleft(lanes[3 * i + 1], 20)).bitwiseOR(F.shiftleft(lanes[3 * i + 2], 40))

    digits = lambda x, k: F.lpad(F.lower(F.hex(x)), k, "0")
    lanes = F.zip_with(signs(a), signs(b), lambda x, y: both(x, y, MASK20))
    # an array of one binds the lanes, so that they are worked out once
    text = F.transform(F.array(lanes), lambda v: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(THREES - 1)), lambda i: digits(three(v, i), 15)), ""))[0]
    strong = [both(_number(a, AT_STRONG + 8 * k, 8), _number(b, AT_STRONG + 8 * k, 8), 0xFFFFFFFF) for k in range(len(STRONG))]
    return F.concat(digits(passage_count(a) + sign * passage_count(b), 16), text, *[digits(x, 8) for x in strong])


def added(a: Column, b: Column) -> Column:
    """The fingerprint of both multisets together: ``b``'s passages are inserted into ``a``."""
    return _combined(a, b, 1)


def removed(a: Column, b: Column) -> Column:
    """The fingerprint of ``a`` without ``b``'s passages, all of which ``a`` must hold."""
    return _combined(a, b, -1)


def likeness(a: Column, b: Column, n_a: Column, n_b: Column) -> Column:
    """0 to 1 from two fingerprints' lanes and numbers: the cosine of both texts' sums of random signs; 2 * count - n is such a sum.

    Twice a lane is known modulo 2^21, so this is exact up to 2^20 passages; of
    longer texts the sums nearest to 0 are taken.
    """
    half = MASK20 + 1
    wrapped = lambda v, n: F.pmod(2 * v - n + half, F.lit(2 * half)) - half
    x = F.transform(a, lambda v: wrapped(v, n_a).cast("double"))
    y = F.transform(b, lambda v: wrapped(v, n_b).cast("double"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda t, v: t + v)
    norm = F.sqrt(dot(x, x) * dot(y, y))
    both = (n_a == 0) & (n_b == 0)
    value = F.when(norm > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(x, y) / norm))).otherwise(F.lit(0.0))
    return F.when(both, F.lit(1.0)).otherwise(value)


def successors(keys: DataFrame, bits: int = 10, small: int = 10_000) -> DataFrame:
    """k, next_k for distinct longs ``k`` in descending order; the last one's next is null.

    Neighbours inside a block of 2^bits values come from a window; those across
    blocks from the same rule one level up, until a level is small.
    """
    keys = settle(keys.select("k").distinct())
    if keys.count() <= small:
        return keys.withColumn("next_k", F.lead("k").over(Window.orderBy(F.desc("k"))))
    block = F.shiftright("k", bits)
    inside = Window.partitionBy("block").orderBy(F.desc("k"))
    rows = keys.withColumn("block", block).withColumn("next_k", F.lead("k").over(inside))
    heads = keys.withColumn("block", block).groupBy("block").agg(F.max("k").alias("head"))
    after = successors(heads.select(F.col("block").alias("k")), bits, small).select(F.col("k").alias("block"), F.col("next_k").alias("nb"))
    link = after.join(heads.select(F.col("block").alias("nb"), "head"), "nb").select("block", "head")
    return rows.join(link, "block", "left").select("k", F.coalesce("next_k", "head").alias("next_k"))


def _next_cells(cells: DataFrame) -> DataFrame:
    """bucket, sub, next_bucket, next_sub of distinct (bucket, sub): by descending bucket, then ascending sub; after the last comes the first."""
    firsts = cells.groupBy("bucket").agg(F.min("sub").alias("next_sub"))
    after = settle(successors(cells.select(F.col("bucket").alias("k")))).select(F.col("k").alias("bucket"), F.col("next_k").alias("next_bucket"))
    top = after.agg(F.max("bucket")).first()[0]
    after = after.withColumn("next_bucket", F.coalesce("next_bucket", F.lit(top).cast("long")))
    after = after.join(firsts.withColumnRenamed("bucket", "next_bucket"), "next_bucket")
    inside = cells.withColumn("lead", F.lead("sub").over(Window.partitionBy("bucket").orderBy("sub")))
    joined = inside.join(after, "bucket")
    here = F.col("lead").isNotNull()
    return joined.select("bucket", "sub", F.when(here, F.col("bucket")).otherwise(F.col("next_bucket")).alias("next_bucket"), F.when(here, F.col("lead")).otherwise(F.col("next_sub")).alias("next_sub"))


def with_next_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """bucket, sub, rn, doc_id, text, next_text, outer: the next text in descending id order.

    ``outer`` marks rows whose next one lies in another cell. A bucket spans
    2^BUCKET_BITS consecutive ids; where it has many rows, its order is cut into
    cells (sub), so no task holds more than a cell at once.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    # null ids: a bucket below all others
    rows = rows.withColumn("bucket", F.coalesce(F.shiftright("doc_id", BUCKET_BITS), F.lit(-(1 << 60)))).withColumn("_h", F.xxhash64("text"))
    sizes = settle(rows.groupBy("bucket").agg(F.count("*").alias("rows")))
    hot = sizes.filter(F.col("rows") > HOT_RANGE)
    n_hot = hot.count()
    if n_hot:
        # the place in a bucket's order as a number of 46 bits: ids downwards, then hashes upwards; its first bits make the cell
        place = F.coalesce(F.shiftleft(F.lit((1 << BUCKET_BITS) - 1) - F.pmod("doc_id", F.lit(1 << BUCKET_BITS)), 40), F.lit(0)).bitwiseOR(F.shiftrightunsigned(F.col("_h").bitwiseXOR(F.lit(-(1 << 63))), 24))
        bits = F.least(F.lit(40), F.ceil(F.log2(F.col("rows") / CELL_ROWS)))
        # null ids have no bits of an id, other ranges may be one id's: both need the bits of hashes
        cut = hot.select("bucket", (F.lit(40) - bits).cast("int").alias("_shift"))
        rows = rows.withColumn("_place", place).join(F.broadcast(cut) if n_hot <= BROADCAST_RANGES else cut, "bucket", "left")
        rows = rows.withColumn("sub", F.coalesce(F.expr("shiftright(_place, _shift)"), F.lit(0).cast("long"))).drop("_place", "_shift")
        cells = settle(rows.select("bucket", "sub").distinct())
    else:
        rows = rows.withColumn("sub", F.lit(0).cast("long"))
        cells = sizes.select("bucket", F.lit(0).cast("long").alias("sub"))
    order = Window.partitionBy("bucket", "sub").orderBy(F.col("doc_id").desc_nulls_last(), "_h", "text")
    rows = rows.withColumn("rn", F.row_number().over(order)).withColumn("inner_next", F.lead("text").over(order))
    before = _next_cells(cells).select(F.col("next_bucket").alias("bucket"), F.col("next_sub").alias("sub"), F.col("bucket").alias("for_bucket"), F.col("sub").alias("for_sub"))
    heads = rows.filter("rn = 1").select("bucket", "sub", F.col("text").alias("head_text"))
    heads = heads.join(before, ["bucket", "sub"]).select(F.col("for_bucket").alias("bucket"), F.col("for_sub").alias("sub"), "head_text")
    rows = rows.join(heads, ["bucket", "sub"], "left")
    return rows.select(
        "bucket", "sub", "rn", "doc_id", "text", F.coalesce("inner_next", "head_text").alias("next_text"), F.col("inner_next").isNull().alias("outer")
    )


def _packed(hex64: Column) -> list[Column]:
    """A SHA-256 in hex as five longs of 60 bits at most, so that sums can carry it."""
    return [F.conv(F.substring(hex64, 1 + 15 * i, 15), 16, 10).cast("long") for i in range(5)]


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    Edited: the last third of the code points gives way to the first as many of
    the next document in descending id order (after the last, the first).
    """
    rows = with_next_text(docs, id_col, text_col)
    n = F.length("text").cast("long")
    cut = F.floor(n / 3).cast("int")
    rows = rows.withColumn("n_chars", n).withColumn(
        "edited", F.concat(F.substring(F.col("text"), F.lit(1), (n - cut).cast("int")), F.substring(F.col("next_text"), F.lit(1), cut))
    )
    sha = F.sha2("edited", 256)
    rows = rows.withColumn("sha", F.array(*_packed(sha)))
    versions = F.array(
        F.struct(F.lit(0).alias("which"), F.col("text").alias("t")),
        F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")),
        F.struct(F.lit(2).alias("which"), F.when(F.col("outer"), F.col("next_text")).alias("t")),
    )
    hashes = [f"h{i}" for i in range(5)]
    key = ["bucket", "sub", "rn"]
    rows = rows.select(*key, "doc_id", "n_chars", *[F.col("sha")[i].alias(h) for i, h in enumerate(hashes)], F.explode(F.filter(versions, lambda v: v["t"].isNotNull())).alias("v"))
    parts = rows.select(*key, "doc_id", "n_chars", *hashes, F.col("v.which").alias("which"), F.explode(F.concat(F.array(F.lit("")), passages(F.col("v.t")))).alias("p"))
    summed = parts.groupBy(*key, "which").agg(*[F.max(c).alias(c) for c in ["doc_id", "n_chars", *hashes]], *lane_sums(F.col("p")))
    sha_back = F.concat(*[F.lpad(F.lower(F.hex(h)), 15 if i < 4 else 4, "0") for i, h in enumerate(hashes)])
    summed = summed.select(*key, "which", "doc_id", "n_chars", sha_back.alias("edited_sha256"), fingerprint_string().alias("fp"))
    of = lambda i: F.max(F.when(F.col("which") == i, F.col("fp")))
    per = summed.groupBy(*key).agg(
        F.max("doc_id").alias("doc_id"), F.max("n_chars").alias("n_chars"), F.max("edited_sha256").alias("edited_sha256"),
        of(0).alias("fingerprint"), of(1).alias("edited_fingerprint"), of(2).alias("outer_fp"),
    )
    per = per.withColumn("next_fp", F.coalesce(F.lead("fingerprint").over(Window.partitionBy("bucket", "sub").orderBy("rn")), F.col("outer_fp")))
    for name, fp in (("a", "fingerprint"), ("b", "edited_fingerprint"), ("c", "next_fp")):
        per = per.withColumn(name, signs(F.col(fp))).withColumn(f"n_{name}", passage_count(F.col(fp)))
    same = lambda other, value: F.when(F.col("fingerprint") == F.col(other), F.lit(1.0)).otherwise(value)
    return per.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        same("edited_fingerprint", likeness(F.col("a"), F.col("b"), F.col("n_a"), F.col("n_b"))).alias("near_edited"),
        same("next_fp", likeness(F.col("a"), F.col("c"), F.col("n_a"), F.col("n_c"))).alias("near_next"),
    )


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_passages, fingerprint of every row, by the same sums (rows of one id are told apart)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t")).withColumn("_row", F.monotonically_increasing_id())
    parts = rows.select("_row", "doc_id", F.explode(F.concat(F.array(F.lit("")), passages(F.col("t")))).alias("p"))
    summed = parts.groupBy("_row").agg(F.max("doc_id").alias("doc_id"), *lane_sums(F.col("p")))
    return summed.select("doc_id", F.col("n").alias("n_passages"), fingerprint_string().alias("fingerprint"))
