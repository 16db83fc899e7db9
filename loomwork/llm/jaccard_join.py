"""N-gram Jaccard join: token-combination prefixes, then exact verification.

Two sets with Jaccard similarity of at least PERCENT share a token among the
first n - ceil(PERCENT n) + 1 of either, and two among one more, in any order that
both follow. The order here puts frequent tokens last. Rare tokens of the
extended prefix are indexed alone. Frequent ones are indexed as combinations of
two: who shares no rare token shares a pair of frequent ones. Sets with very
many frequent tokens in their prefix are indexed by the single tokens instead,
and the others meet them there (but not one another).

Which tokens are frequent comes from counts within each task, summed; the table
has FREQUENT rows at most and only bears on speed: any order gives all links.

Equal sets are one class. Classes that share a key are compared in three rounds.
First each with the class that stands first in most of its groups, which joins
most of a group without comparing all pairs. Then, in groups that still hold
several components, each class with the class of every other component that it
shares most keys with; then every pair across components that is left. A pair is
only compared if the keys it shares allow the similarity: all shared rare tokens
of both prefixes are known, so what may still be common lies beyond them. Only sets
of about one length can be linked, so a key's members meet by bands of length:
shingles that unrelated texts hold by chance, more of them the larger the
corpus, make no large groups. Groups of many members are compared in blocks,
which hand on only such pairs. So no link that matters for components is lost
and no group of alike texts costs more than its size. Large hubs are dealt over several tasks. Links inside a component
are not looked for by these rounds: who asks for the number of links gets a pass
that verifies every pair which may be linked, block by block in groups of alike
texts.

Before whole sets travel, a pair has to pass its sketches: a set's tokens are
counted by their low bits, and two sets share at most the sum of the lesser
counts. This bound loses no link and leaves few pairs that are none.

Whatever gathers a key is summed before it is shuffled and joined back, so no
key's rows need to meet in one task. Rows are numbered once, in a copy in
buckets, so the input may be any DataFrame.

Defined results: null and empty texts have no shingles and no links; fewer than
five words make one shingle; rows with one id are separate nodes, the component
id is the least doc_id in it, null ids aside; an empty table gives no rows; extra
columns are not used, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import columns_of, drop_stored, free_name, numbered, stored, text_of
from loomwork.llm.components import components
from loomwork.llm.shingles import shingle_sets

PERCENT = 80
#: Rows of the table of frequent tokens, at most, and the least count in it.
FREQUENT = 1 << 18
LEAST_COUNT = 6
#: Frequent tokens in a prefix up to which combinations are indexed.
COMBINE = 12
#: Members of a key, of about one length, up to which they are joined, times as many pairs if most are of one component, and
#: classes of a family compared at a time.
SMALL_GROUP = 24
INSIDE = 50
FAMILY_BLOCK = 1024
#: Tokens counted at a time, and members of a hub that one task compares.
COUNT_AT_ONCE = 1 << 20
HUB = 512
#: Sets that a task remembers so as to send equal ones once.
REMEMBERED = 1 << 17
#: Keys that may have more members than this are not counted, as that would gather them.
HOT_KEY = 4096


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - (-(-percent * n // 100)) + 1


def _frequent_tokens(rows: DataFrame, limit: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens ascending, counts): those seen in several sets of one task, by their summed counts."""

    def run(batches):
        held, n = [], 0
        seen: set[int] = set()

        def flush():
            t, c = np.unique(np.concatenate(held), return_counts=True)
            keep = c > 1
            return pa.RecordBatch.from_arrays([pa.array(t[keep].view(np.int64)), pa.array(c[keep].astype(np.int64))], names=["token", "n"])

        for batch in batches:
            for s in shingle_sets(batch.column(1)):
                mark = hash(s.tobytes())
                if len(s) and mark not in seen:
                    seen = seen if len(seen) < REMEMBERED else set()
                    seen.add(mark)
                    held.append(s)
                    n += len(s)
                if n >= COUNT_AT_ONCE:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    sums = rows.select("row", "text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    got = sums.orderBy(F.desc("n"), "token").limit(limit).toPandas()
    tokens = got.token.to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], got.n.to_numpy(np.int64)[order]


#: Roles of index entries. A SMALL entry meets only a LARGE one.
RARE, SMALL, PAIR, LARGE = 0, 1, 2, 3
#: Kinds of rows in the index: a set, an entry to be counted by its key, an entry that is kept as it is.
SET, ENTRY, HOT_ENTRY = 0, 1, 2


def sketch(s: np.ndarray) -> bytes:
    """Tokens counted by their low bits, four bits a count; about two tokens to a count."""
    n = 8
    while 2 * n < len(s):
        n *= 2
    while True:
        c = np.bincount((s & np.uint64(n - 1)).astype(np.int64), minlength=n)
        if c.max() < 16:
            return (c[: n // 2] | c[n // 2 :] << 4).astype(np.uint8).tobytes()
        n *= 2


def most_shared(a: bytes, b: bytes) -> int:
    """What two sets have in common at most, by their sketches."""
    x, y = (np.frombuffer(v, np.uint8) for v in (a, b))
    x, y = (np.concatenate([v & 15, v >> 4]).astype(np.uint32) for v in (x, y))
    while len(x) != len(y):  # low bits: the halves of the longer one fall together
        if len(x) > len(y):
            x = x[: len(x) // 2] + x[len(x) // 2 :]
        else:
            y = y[: len(y) // 2] + y[len(y) // 2 :]
    return int(np.minimum(x, y).sum())


def _keys_of(s: np.ndarray, tokens: np.ndarray, counts: np.ndarray, percent: int):
    """(keys, roles, how many members each may have, prefix size, frequent tokens in it) under which a set is indexed.

    The number of members is known for frequent tokens only; of others it is 0.
    """
    n = len(s)
    size = min(n, prefix_size(n, percent) + 1)
    at = np.searchsorted(tokens, s)
    common = (at < len(tokens)) & (tokens[np.minimum(at, len(tokens) - 1)] == s) if len(tokens) else np.zeros(n, bool)
    rare = s[~common][:size]
    often, seen = s[common], counts[at[common]]
    left = size - len(rare)
    if left <= 0 or not len(often):
        return rare, np.full(len(rare), RARE, np.int8), np.zeros(len(rare), np.int64), size, 0
    order = np.lexsort((often, seen))[:left]
    often, seen = often[order], seen[order]
    none = np.zeros(len(rare), np.int64)
    # With no second token to share (a set of one), singles must do.
    if len(often) > COMBINE or n < 2 or size < 2:
        return np.concatenate([rare, often]), np.repeat(np.array([RARE, LARGE], np.int8), [len(rare), len(often)]), np.concatenate([none, seen]), size, len(often)
    i, j = np.triu_indices(len(often), 1)
    pairs = (often[i] ^ (often[j] * np.uint64(0x9E3779B97F4A7C15))) + np.uint64(1)
    roles = np.repeat(np.array([RARE, PAIR, SMALL], np.int8), [len(rare), len(pairs), len(often)])
    return np.concatenate([rare, pairs, often]), roles, np.concatenate([none, np.minimum(seen[i], seen[j]), seen]), size, len(often)


def _indexed(rows: DataFrame, tokens: np.ndarray, counts: np.ndarray, percent: int) -> DataFrame:
    """Rows of the three kinds: sets with their class (as key), and entries with key and role; p, h of either.

    Of equal sets in a task one has entries and a sketch.
    """
    sent = rows.sparkSession.sparkContext.broadcast((tokens, counts))
    names = ["kind", "row", "n", "key", "role", "p", "h", "sketch"]
    kinds = [pa.int8(), pa.int64(), pa.int32(), pa.int64(), pa.int8(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches):
        import xxhash

        tokens, counts = sent.value
        seen: set[int] = set()
        for batch in batches:
            sets: list = []
            out: list = [[] for _ in range(7)]
            for row, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1))):
                cls = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)
                if not len(s):
                    sets.append((SET, row, 0, cls, 0, 0, 0, None))
                    continue
                first = cls not in seen
                if first:
                    seen = seen if len(seen) < REMEMBERED else set()
                    seen.add(cls)
                keys, roles, most, size, often = _keys_of(s, tokens, counts, percent)
                sets.append((SET, row, len(s), cls, 0, size, often, sketch(s) if first else None))
                if first:
                    k = len(keys)
                    of_kind = np.where(most > HOT_KEY, HOT_ENTRY, ENTRY).astype(np.int8)
                    for column, x in zip(out, (of_kind, np.full(k, row), np.full(k, len(s), np.int32), keys.view(np.int64), roles, np.full(k, size, np.int32), np.full(k, often, np.int32))):
                        column.append(x)
            if sets:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*sets), kinds)], names=names)
            if out[0]:
                c = [np.concatenate(x) for x in out]
                for x in range(0, len(c[0]), 100_000):
                    part = [v[x : x + 100_000] for v in c]
                    yield pa.RecordBatch.from_arrays([*[pa.array(v, t) for v, t in zip(part, kinds)], pa.nulls(len(part[0]), pa.binary())], names=names)

    return rows.select("row", "text").mapInArrow(run, "kind byte, row long, n int, key long, role byte, p int, h int, sketch binary")


def _between(groups: DataFrame, member: str, *more) -> DataFrame:
    """key, lo, hi (least and greatest member) and ``more`` of the keys with several members."""
    return groups.groupBy("key").agg(F.min(member).alias("lo"), F.max(member).alias("hi"), *more).filter("lo <> hi")


def _sieved(tests: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """hub, other: those of the tests that may be linked by their sketches (c, n, sketch)."""

    def run(batches):
        for batch in batches:
            keep = []
            for m, n, a, b in zip(*[batch.column(k).to_pylist() for k in range(2, 6)]):
                keep.append(most_shared(a, b) * (100 + percent) >= percent * (m + n))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], names=["hub", "other"])

    one = sketches.select(F.col("c").alias("hub"), F.col("n").alias("m"), F.col("sketch").alias("a"))
    two = sketches.select(F.col("c").alias("other"), "n", F.col("sketch").alias("b"))
    near = (F.col("m") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("m") * percent)
    both = tests.join(one, "hub").join(two, "other").filter(near)
    return both.select("hub", "other", "m", "n", "a", "b").mapInArrow(run, "hub long, other long")


def _sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """row, tokens of the wanted rows (c)."""

    def run(batches):
        for batch in batches:
            raw = [s.tobytes() for s in shingle_sets(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["row", "tokens"])

    return rows.select("row", "text").join(wanted.select(F.col("c").alias("row")).distinct(), "row", "left_semi").mapInArrow(run, "row long, tokens binary")


def _linked(sets: DataFrame, tests: DataFrame, percent: int) -> DataFrame:
    """hub, other: those of the tested pairs that reach the similarity."""
    loads = tests.groupBy("hub").agg(F.ceil(F.count("*") / HUB).cast("int").alias("parts"))
    members = tests.join(loads, "hub").select(F.col("other").alias("row"), "hub", F.pmod(F.xxhash64("other"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"))
    hubs = loads.select(F.col("hub").alias("row"), "hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    shipped = members.unionByName(hubs).join(sets, "row").select("hub", "part", "role", "row", "tokens")

    def verify(batches):
        hub, own = None, None
        for batch in batches:
            found: tuple[list, list] = ([], [])
            for h, _, role, row, raw in zip(*[c.to_pylist() for c in batch.columns]):
                s = np.frombuffer(raw, np.uint64)
                if role == 0:
                    hub, own = h, s
                    continue
                assert hub == h
                small, large = (s, own) if len(s) < len(own) else (own, s)
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                if 100 * both >= percent * (len(s) + len(own) - both):
                    found[0].append(h)
                    found[1].append(row)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], names=["hub", "other"])

    return shipped.repartition("hub", "part").sortWithinPartitions("hub", "part", "role").mapInArrow(verify, "hub long, other long")


def _banded(named: DataFrame, percent: int) -> DataFrame:
    """The members of each key by bands of length (g), where several components meet; low, big.

    Lengths that allow a link are in one band or in two that follow each other, so
    each member is in its own band and, as a ``low`` one, in the next. Two low ones
    do not meet. ``big``: more pairs of two components meet there than among
    SMALL_GROUP members, or INSIDE times as many in all. So copies that are one
    component already make no band large, whoever else holds their keys.
    """
    # a trifle wider than the lengths allow, so that rounding puts no two of them further apart
    wide = math.log(max(100 / percent, 1.01) * (1 + 1e-9))
    both = named.withColumn("low", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("g", (F.floor(F.log("n") / F.lit(wide)) + F.col("low")).cast("int"))
    meet = lambda full, low: full * (full - 1) / 2 + full * low
    each = both.groupBy("key", "g", "component").agg(F.sum(1 - F.col("low")).alias("full"), F.sum("low").alias("lows"))
    met = each.groupBy("key", "g").agg(meet(F.sum("full"), F.sum("lows")).alias("all"), F.sum(meet(F.col("full"), F.col("lows"))).alias("inside")).filter("all > inside")
    few = SMALL_GROUP * (SMALL_GROUP - 1) // 2
    return both.join(met.select("key", "g", ((F.col("all") - F.col("inside") > few) | (F.col("all") > INSIDE * few)).alias("big")), ["key", "g"])


def _families(banded: DataFrame) -> DataFrame:
    """c, family: classes that meet in bands of many members, directly or by others."""
    large = banded.filter("big").select("key", "g", "c")
    first = large.groupBy("key", "g").agg(F.min("c").alias("first"))
    out = components(large.join(first, ["key", "g"]), "first", "c")
    path = out.scratch_path
    out = out.select(F.col("node").alias("c"), F.col("component").alias("family"))
    out.scratch_path = path
    return out


def _may_link(named: DataFrame, banded: DataFrame, family: DataFrame, percent: int) -> tuple[DataFrame, DataFrame | None]:
    """(pairs, dealt): what may be linked across components by small bands of keys, and by the large ones of families.

    pairs: a, b, keys, ca, cb. dealt: the keys of the classes of each family, for
    every two of its blocks; None without large bands. ``family``: of _families(),
    of these keys or more.

    named: key, role, n, p, h, c, w, component, a stored table; banded: of
    _banded(), stored. What two sets share is at most the
    tokens shared by both prefixes and what either has beyond its prefix. Members
    of small bands are joined; of the others it is only assumed here
    that all are shared. Classes in such large bands form families, which are
    compared block by block, with all shared keys counted.
    """
    large = banded.filter("big")
    heavy = large.select("c", "key", "w").distinct().groupBy("c").agg(F.sum("w").alias("b"))
    light = banded.filter("not big").join(heavy, "c", "left").withColumn("b", F.coalesce("b", F.lit(0)))
    x, y = light.alias("x"), light.alias("y")
    near = (F.col("x.n") * 100 >= F.col("y.n") * percent) & (F.col("y.n") * 100 >= F.col("x.n") * percent)
    meet = ((F.col("x.role") != SMALL) | (F.col("y.role") != SMALL)) & (F.col("x.low") + F.col("y.low") < 2)
    across = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.g") == F.col("y.g")) & (F.col("x.component") < F.col("y.component")) & near & meet)
    # frequent tokens are either in pairs, or single in small or large bands: of all of them it is assumed
    unknown = F.least(F.col("x.h") + F.col("x.b"), F.col("y.h") + F.col("y.b"))
    pairs = across.groupBy(F.col("x.c").alias("a"), F.col("y.c").alias("b")).agg(
        F.sum(F.when((F.col("x.role") == RARE) & (F.col("y.role") == RARE), F.col("x.w")).otherwise(0)).alias("rare"), F.sum("x.w").alias("keys"),
        F.first("x.component").alias("ca"), F.first("y.component").alias("cb"), F.first(unknown).alias("often"),
        F.first(F.greatest(F.col("x.n") - F.col("x.p"), F.col("y.n") - F.col("y.p"))).alias("beyond"),
        F.first(F.ceil(F.lit(percent) * (F.col("x.n") + F.col("y.n")) / F.lit(100 + percent))).alias("needed"),
    )
    pairs = pairs.filter(F.col("rare") + F.col("often") + F.col("beyond") >= F.col("needed")).select("a", "b", "keys", "ca", "cb")
    if large.isEmpty():
        return pairs, None
    # classes that no large band of several components holds any more need no block
    family = family.join(large.select("c").distinct(), "c", "left_semi")
    # Every key of a class in a family; pairs of tokens bring classes together, single tokens also count.
    weight = F.when(F.col("role") == PAIR, 0).otherwise(F.col("w")).alias("w")
    whole = named.join(family, "c").groupBy("family", "c").agg(
        F.collect_list(F.struct("key", weight)).alias("keys"), F.first("n").alias("n"), F.first("p").alias("p"), F.first("h").alias("h"), F.first("component").alias("component")
    )
    blocks = family.groupBy("family").agg(F.ceil(F.count("*") / FAMILY_BLOCK).cast("int").alias("k"))
    dealt = whole.join(blocks, "family").withColumn("own", F.pmod(F.xxhash64("c"), F.col("k")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("family", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "c", "n", "p", "h", "component", F.col("keys.key").alias("key"), F.col("keys.w").alias("w"))
    return pairs, dealt


def _masks(table: pa.Table, percent: int):
    """(r, shared keys of r and each class, which of these may be linked to r) in two blocks of a family; each pair once."""
    c, n, p, h, comp, own = (table.column(k).to_numpy() for k in ("c", "n", "p", "h", "component", "own"))
    few = np.where(h <= COMBINE, h, 0)  # of these the frequent tokens are known in pairs only
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    lists = table.column("key").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    keys, weight = lists.flatten().to_numpy(), table.column("w").combine_chunks().flatten().to_numpy()
    order = np.argsort(keys, kind="stable")
    doc = np.repeat(np.arange(len(c)), sizes)[order]
    starts = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
    group = np.empty(len(keys), np.int64)
    group[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))
    ends = np.append(starts[1:], len(keys))
    at = np.concatenate([[0], np.cumsum(sizes)])
    for r in range(len(c)):
        if i != j and own[r] != i:
            continue
        mine = group[at[r] : at[r + 1]]
        members = np.concatenate([doc[starts[g] : ends[g]] for g in mine]) if len(mine) else doc[:0]
        met = np.bincount(members, minlength=len(c)) > 0
        shared = np.bincount(members, weights=np.repeat(weight[at[r] : at[r + 1]], ends[mine] - starts[mine]), minlength=len(c))
        needed = np.ceil(percent * (n[r] + n) / (100 + percent))
        ok = met & (comp != comp[r]) & (shared + np.minimum(few[r], few) + np.maximum(n[r] - p[r], n - p) >= needed) & (n * 100 >= n[r] * percent) & (n[r] * 100 >= n * percent)
        ok &= (own == j) if i != j else (np.arange(len(c)) > r)
        yield r, shared, ok


def _across(named: DataFrame, banded: DataFrame, family: DataFrame, percent: int) -> DataFrame:
    """a, b, keys, ca, cb: pairs of classes of different components whose shared keys allow the similarity."""
    pairs, dealt = _may_link(named, banded, family, percent)
    if dealt is None:
        return pairs

    def compare(table: pa.Table) -> pa.Table:
        c, comp = (table.column(k).to_numpy() for k in ("c", "component"))
        out: list[list] = [[], [], [], [], []]
        for r, shared, ok in _masks(table, percent):
            for o in np.flatnonzero(ok).tolist():
                a, b = (r, o) if comp[r] < comp[o] else (o, r)
                for column, v in zip(out, (c[a], c[b], int(shared[o]), comp[a], comp[b])):
                    column.append(int(v))
        return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(("a", "b", "keys", "ca", "cb"), out)})

    found = dealt.groupBy("family", "i", "j").applyInArrow(compare, "a long, b long, keys long, ca long, cb long")
    return pairs.unionByName(found).groupBy("a", "b").agg(F.max("keys").alias("keys"), F.first("ca").alias("ca"), F.first("cb").alias("cb"))


def _tested(rows: DataFrame, sketches: DataFrame, tests: DataFrame, percent: int) -> DataFrame:
    """hub, other, a stored table: those of the tests (hub, other) that are linked, by their sketches and then by their sets."""
    tests = stored(_sieved(tests, sketches, percent), "tests")
    wanted = tests.select(F.col("hub").alias("c")).unionByName(tests.select(F.col("other").alias("c")))
    sets = stored(_sets(rows, wanted), "sets")
    out = stored(_linked(sets, tests, percent), "links")
    drop_stored(sets, tests)
    return out


def _links_in_families(rows: DataFrame, dealt: DataFrame, copies: DataFrame, percent: int) -> DataFrame:
    """c, n_links: linked rows of other classes in the same family.

    Of each two blocks only what may be linked comes together as whole sets, with
    a bit for each pair to be verified, so pairs are never rows.
    """

    def mark(table: pa.Table) -> pa.Table:
        c = table.column("c").to_numpy()
        masks = np.zeros((len(c), len(c)), bool)
        for r, _, ok in _masks(table, percent):
            masks[r] = ok
        keep = np.flatnonzero(masks.any(0) | masks.any(1))
        keep = keep[np.argsort(c[keep])]
        bits = [np.packbits(masks[r, keep]).tobytes() for r in keep]
        first = {k: table.column(k)[0] for k in ("family", "i", "j")}
        out = {k: pa.array([v.as_py()] * len(keep), v.type) for k, v in first.items()}
        return pa.table(out | {"c": pa.array(c[keep], pa.int64()), "bits": pa.array(bits, pa.binary())})

    def verify(table: pa.Table) -> pa.Table:
        table = table.sort_by("c")
        c, size = table.column("c").to_numpy(), table.column("size").to_numpy()
        sets = [np.frombuffer(t.as_py(), np.uint64) for t in table.column("tokens")]
        n = np.array([len(s) for s in sets])
        at = np.concatenate([[0], np.cumsum(n)])
        token = np.unique(np.concatenate(sets), return_inverse=True)[1]
        own, got = np.zeros(int(token.max()) + 1, bool), np.zeros(len(c), np.int64)
        for r, bits in enumerate(table.column("bits")):
            others = np.flatnonzero(np.unpackbits(np.frombuffer(bits.as_py(), np.uint8), count=len(c)))
            if not len(others):
                continue
            own[token[at[r] : at[r + 1]]] = True
            starts = np.concatenate([[0], np.cumsum(n[others])[:-1]])
            both = np.add.reduceat(own[token[np.arange(n[others].sum()) + np.repeat(at[others] - starts, n[others])]].astype(np.int64), starts)
            own[token[at[r] : at[r + 1]]] = False
            linked = others[100 * both >= percent * (n[r] + n[others] - both)]
            got[r] += size[linked].sum()
            got[linked] += size[r]
        return pa.table({"c": pa.array(c, pa.int64()), "n_links": pa.array(got, pa.int64())})

    near = stored(dealt.groupBy("family", "i", "j").applyInArrow(mark, "family long, i int, j int, c long, bits binary"), "near")
    sets = stored(_sets(rows, near.select("c")), "sets")
    whole = near.join(sets.withColumnRenamed("row", "c"), "c").join(copies, "c")
    return whole.groupBy("family", "i", "j").applyInArrow(verify, "c long, n_links long")


def _all_links(rows: DataFrame, members: DataFrame, groups: DataFrame, sketches: DataFrame, links: DataFrame, done: DataFrame, percent: int) -> DataFrame:
    """class_row, n_links: how many other rows each row of a class is linked to, inside its component too.

    links: those found among the pairs ``done``. Pairs in one family are all verified
    there; the others are tested unless they were.
    """
    named = groups.withColumn("component", F.col("c"))
    banded = stored(_banded(named, percent), "banded")
    family = _families(banded)
    pairs, dealt = _may_link(named, banded, family, percent)
    pairs = pairs.select(F.least("a", "b").alias("hub"), F.greatest("a", "b").alias("other")).distinct()
    copies = stored(members.filter("n_shingles > 0").groupBy(F.col("class_row").alias("c")).agg(F.count("*").alias("size")), "copies")
    pairs = pairs.join(done, ["hub", "other"], "left_anti")
    if dealt is not None:
        one, two = family.select(F.col("c").alias("hub"), F.col("family").alias("_f")), family.select(F.col("c").alias("other"), F.col("family").alias("_g"))
        apart = lambda p: p.join(one, "hub", "left").join(two, "other", "left").filter("_f is null or _g is null or _f <> _g").select("hub", "other")
        pairs, links = apart(pairs), apart(links)
    links = links.unionByName(_tested(rows, sketches, pairs, percent))
    each = links.select(F.col("hub").alias("c"), F.col("other").alias("d")).unionByName(links.select(F.col("other").alias("c"), F.col("hub").alias("d")))
    counts = each.join(copies.withColumnRenamed("c", "d"), "d").select("c", F.col("size").alias("n_links"))
    if dealt is not None:
        counts = counts.unionByName(_links_in_families(rows, dealt, copies, percent))
    counts = counts.unionByName(copies.select("c", (F.col("size") - 1).alias("n_links")))
    return counts.groupBy(F.col("c").alias("class_row")).agg(F.sum("n_links").alias("n_links"))


def _entries(rows: DataFrame, percent: int, frequent: int, least: int) -> DataFrame:
    """The index, a stored table, without entries whose key nobody shares."""
    tokens, counts = _frequent_tokens(rows, frequent, least)
    index = _indexed(rows, tokens, counts, percent)
    # One pass writes all kinds. Only entries with few members are gathered by key.
    shared = Window.partitionBy("kind", "_k")
    entries = index.withColumn("_k", F.when(F.col("kind") == ENTRY, F.col("key")).otherwise(F.col("row")))
    entries = entries.withColumn("_n", F.count("*").over(shared)).withColumn("_full", F.max((F.col("role") != SMALL).cast("int")).over(shared))
    return stored(entries.filter((F.col("kind") != ENTRY) | ((F.col("_n") > 1) & (F.col("_full") == 1))).drop("_k", "_n", "_full"), "entries")


def _groups(entries: DataFrame, sketches: DataFrame) -> DataFrame:
    """key, role, n, p, h, c, w, a stored table: the keys that several classes (c) share.

    Keys with the same members, such as those of one passage, go on as one with
    its weight (w).
    """
    own = stored(entries.filter(F.col("kind") != SET).join(sketches.select(F.col("c").alias("row")), "row", "left_semi").select("key", "role", "n", "p", "h", F.col("row").alias("c")), "own")
    marks = _between(
        own, "c", F.bit_xor(F.xxhash64("c", "role")).alias("x"), F.sum(F.pmod(F.xxhash64(F.lit(1), "c"), F.lit(1 << 40))).alias("y"), F.count("*").alias("m"), F.min("role").alias("r"), F.max((F.col("role") != SMALL).cast("int")).alias("full")
    )
    stands = marks.filter("full = 1").groupBy("x", "y", "m", "r").agg(F.min("key").alias("key"), F.count("*").alias("w")).select("key", "w")
    out = stored(own.join(stands, "key"), "groups")
    drop_stored(own)
    return out


def _first_tests(groups: DataFrame) -> DataFrame:
    """hub, other: each class with the one that leads most of its groups.

    A group is led by the full member of about one size that shares most keys.
    What copies were made from has no words of its own, so all of its prefix is shared.
    """
    share = groups.groupBy("c").agg(F.sum("w").alias("e"))
    joint = groups.join(share, "c").withColumn("band", F.floor(F.log("n") / F.log(F.lit(1.25)))).withColumn("small", (F.col("role") == SMALL).cast("int"))
    leads = joint.groupBy("key", "band").agg(F.min(F.struct("small", (-F.col("e")).alias("e"), "n", "c")).alias("lead")).filter("lead.small = 0").select("key", "band", F.col("lead.c").alias("hub"))
    stars = joint.join(leads, ["key", "band"]).filter("hub <> c").groupBy("hub", "c").agg(F.sum("w").alias("keys"))
    tests = stars.groupBy("c").agg(F.max(F.struct("keys", "hub")).alias("best")).select("best.hub", F.col("c").alias("other"))
    return tests.select(F.least("hub", "other").alias("hub"), F.greatest("hub", "other").alias("other")).distinct()


def _join(rows: DataFrame, percent: int, frequent: int, least: int, count_links: bool) -> DataFrame:
    """As join(), of numbered rows: row, doc_id, text."""
    entries = _entries(rows, percent, frequent, least)
    sets = entries.filter(F.col("kind") == SET).select("row", "n", F.col("key").alias("cls"), "sketch")
    first = sets.filter("sketch is not null").groupBy("cls", "n").agg(F.min("row").alias("class_row"))
    members = stored(sets.join(first, ["cls", "n"], "left").select("row", F.col("n").cast("long").alias("n_shingles"), F.coalesce("class_row", "row").alias("class_row"), "sketch"), "members")
    sketches = members.filter("row = class_row and sketch is not null").select(F.col("row").alias("c"), F.col("n_shingles").alias("n"), "sketch")
    members = members.drop("sketch")
    groups = _groups(entries, sketches)
    drop_stored(entries)

    done = stored(_first_tests(groups), "done")
    links = [_tested(rows, sketches, done, percent)]
    found = components(links[0], "hub", "other")

    # Rounds two and three: what shares keys but no component yet.
    family = None
    for every in (False, True):
        labels = found.select(F.col("node").alias("c"), "component")
        named = groups.join(labels, "c", "left").withColumn("component", F.coalesce("component", "c"))
        named = stored(named.join(_between(named, "component").select("key"), "key"), "named")
        banded = stored(_banded(named, percent), "banded")
        if banded.isEmpty():
            break
        family = _families(banded) if family is None else family  # the later round's bands are among those of this one
        pairs = _across(named, banded, family, percent)
        if not every:
            pairs = stored(pairs, "pairs")
            one = lambda c, other: pairs.groupBy(c, other).agg(F.max(F.struct("keys", "a", "b")).alias("best")).select("best.a", "best.b")
            pairs = one("a", "cb").unionByName(one("b", "ca"))
        pairs = pairs.select(F.least("a", "b").alias("hub"), F.greatest("a", "b").alias("other")).distinct()
        fresh = stored(pairs.join(done, ["hub", "other"], "left_anti"), "fresh")
        drop_stored(named, banded)
        if fresh.isEmpty():
            break
        done = done.unionByName(fresh)
        links.append(_tested(rows, sketches, fresh, percent))
        before, found = found, components(found.select(F.col("node").alias("hub"), F.col("component").alias("other")).unionByName(links[-1]), "hub", "other")
        drop_stored(before)

    labels = found.select(F.col("node").alias("class_row"), "component")
    out = members.join(labels, "class_row", "left").withColumn("component", F.coalesce("component", "class_row")).join(rows.select("row", "doc_id"), "row")
    out = stored(out, "rows")
    drop_stored(found, family)
    least_id = out.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    whole = out.join(least_id, "component")
    if count_links:
        every_link = links[0]
        for x in links[1:]:
            every_link = every_link.unionByName(x)
        n_links = stored(_all_links(rows, members, groups, sketches, every_link, done, percent), "n_links")
        whole = whole.join(n_links, "class_row", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    drop_stored(groups)
    return whole.select("doc_id", "n_shingles", "component_id", "row", "class_row", "component", *(["n_links"] if count_links else []))


def join(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, least: int = LEAST_COUNT, count_links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, row (a number of its own), class_row, component (a row of it).

    With count_links also n_links: how many other rows are linked to this one, all
    pairs verified, equal sets and pairs inside a component too. This is a pass of
    its own, which components do not need.
    """
    rows = numbered(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")))
    return _join(rows, percent, frequent, least, count_links)


def one_of_each(docs: DataFrame, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, least: int = LEAST_COUNT) -> DataFrame:
    """The rows of ``docs``, one for each component: the one with the least id; of several rows with that id any one."""
    name = free_name(docs, "row")
    whole = numbered(docs, name)
    rows = whole.select(F.col(name).alias("row"), F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    found = _join(rows, percent, frequent, least, False)
    # A component is as large as its group of copies, so its first row is found by sums, not by a sorted window.
    # Rows of unlinked components may have one id or none, so the component is not told by its id.
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("best"))
    return whole.join(first.select(F.col("best.row").alias(name)), name, "left_semi").select(*columns_of(docs))
