"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of shuffled documents. A document's virtual finish time
is the number of words its source has queued up to and with it, divided by the
source's target. Serving all queues in order of finish time until the budget is
spent gives every source its share at any point of the mix.

Running sums never gather a source: rows are cut into cells by their shuffle
key and cells are summed first. Cells are accumulated in the same way, in cells
of FAN cells, level by level, so that no task accumulates more than FAN of them.

Defined results: null text has size 0; null source is a source of its own and
comes last; documents of size 0 take 0; rows with one id or none are documents
of their own, each with its own share; an empty table gives an empty table;
mix() does not carry over extra columns, mixed_documents() keeps them whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import WORD, columns_of, free_name, numbered, settle, stored, text_of

#: Weights dealt to the sources in code-point order, again and again.
WEIGHTS = (5.0, 2.0, 1.0)
#: No document is repeated more often than this.
MAX_EPOCHS = 3
#: Tables of sources up to this many rows are broadcast; longer ones are joined by shuffle.
BROADCAST_SOURCES = 10_000
#: Rows aimed at in one cell of a running sum.
CELL_ROWS = 256
#: Cells accumulated together, as a power of two.
FAN_BITS = 10


def word_count(col: str = "text") -> Column:
    return F.regexp_count(text_of(col), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, weight, target: one row for each source.

    Water filling: with sources in order of (cap / weight), those before some
    point stop at their cap and the rest share what is left by weight. The table
    has one row a source, so its windows are small.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Binary order of UTF-8 is code-point order.
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("pos", F.row_number().over(order) - 1)
    per = per.withColumn("weight", F.element_at(cycle, (F.col("pos") % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "pos")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spent = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    budget = F.sum("source_size").over(whole).cast("double")
    per = per.withColumn("level_here", (budget - spent) / left)
    # The level that holds is that of the first source which stays under its cap.
    under = F.col("cap") > F.col("level_here") * F.col("weight")
    per = per.withColumn("level", F.first(F.when(under, F.col("level_here")), ignorenulls=True).over(whole))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight")))
    return per.select("source", "source_size", "weight", target.alias("target"))


def _ahead(cells: DataFrame, group: list[str], cell: str, top: int, fan_bits: int) -> DataFrame:
    """group, cell, _ahead: the sum of _sum over a group's cells before this one. Cells are numbered from 0 to ``top``."""
    if top >> fan_bits == 0:
        before = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
        return cells.select(*group, cell, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_ahead"))
    up = f"{cell}_"  # a name of its own at every level
    cells = cells.withColumn(up, F.shiftright(cell, fan_bits))
    above = _ahead(cells.groupBy(*group, up).agg(F.sum("_sum").alias("_sum")), group, up, top >> fan_bits, fan_bits)
    above = above.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col(up).alias("_of_up"), F.col("_ahead").alias("_far"))
    inside = Window.partitionBy(*group, up).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    here = cells.withColumn("_near", F.coalesce(F.sum("_sum").over(inside), F.lit(0)))
    on = F.col(up) == F.col("_of_up")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return here.join(above, on).select(*group, cell, (F.col("_near") + F.col("_far")).alias("_ahead"))


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str, cell: str, top: int, out: str, fan_bits: int = FAN_BITS) -> DataFrame:
    """Adds ``out``: the sum of ``value`` in ``group`` over all rows up to this one.

    ``cell``, from 0 to ``top``, must grow with ``order``. Sums of cells go ahead;
    no task ever holds more than a cell's rows or 2^fan_bits cells of a group.
    """
    cells = _ahead(df.groupBy(*group, cell).agg(F.sum(value).alias("_sum")), group, cell, top, fan_bits)
    cells = cells.select(*[F.col(g).alias(f"_{g}") for g in group], F.col(cell).alias("_of_cell"), "_ahead")
    on = F.col(cell) == F.col("_of_cell")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_{g}"))
    inside = Window.partitionBy(*group, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = df.withColumn("_here", F.sum(value).over(inside))
    return here.join(cells, on).withColumn(out, F.col("_here") + F.col("_ahead")).drop("_here", "_ahead", "_of_cell", *[f"_{g}" for g in group])


def queue_copies(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 17, id_col: str = "doc_id", row_col: str | None = None):
    """(rows, copies): every document with its size and target, and the copies that the mix serves.

    rows: _row, doc_id, size, source_size, target. copies: _row, size, epoch, finish,
    words; ``words`` is the size but for the copy that the budget cuts. _row is
    ``row_col``, if given, else a number made here.
    """
    sizes = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col("source"),
        word_count().alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64("text")).alias("_key"),
        (F.monotonically_increasing_id() if row_col is None else F.col(row_col)).alias("_row"),
    )
    sizes = stored(sizes, "sizes")
    targets = settle(source_targets(sizes, weights, max_epochs))
    stats = sizes.agg(F.count("*").alias("n"), F.sum("size").alias("budget")).first()
    n, budget = stats["n"], stats["budget"] or 0
    cells = max(1, n // CELL_ROWS)
    src = targets.select(F.col("source").alias("_src"), "source_size", "target")
    src = F.broadcast(src) if targets.count() <= BROADCAST_SOURCES else src
    rows = sizes.join(src, F.col("source").eqNullSafe(F.col("_src"))).drop("_src")

    # A source's queue: its documents in shuffled order, once more for each epoch.
    part = F.pmod(F.shiftright("_key", 20), F.lit(1 << 20))
    queued = rows.filter("size > 0").withColumn("_part", part).withColumn("_cell", (F.col("_part") * cells / (1 << 20)).cast("int"))
    once = running_sum(queued, ["source"], ["_part", "_key", "doc_id", "_row"], "size", "_cell", cells, "_upto")
    epochs = F.sequence(F.lit(0), F.lit(max_epochs - 1))
    queue = (
        once.withColumn("epoch", F.explode(epochs))
        .withColumn("_end", F.col("_upto") + F.col("epoch") * F.col("source_size"))
        # a copy that starts at or beyond its source's target is never served
        .filter((F.col("_end") - F.col("size")) < F.col("target"))
        .withColumn("finish", F.col("_end") / F.col("target"))
        .select("_row", "_key", "doc_id", "size", "epoch", "finish")
    )
    # Finish times are spread evenly over 0 to 1 by construction, so even steps make even cells.
    step = F.least(F.floor(F.col("finish") * cells), F.lit(2 * cells)).cast("int")
    served = running_sum(
        queue.withColumn("_step", step).withColumn("_all", F.lit(0)), ["_all"], ["finish", "_key", "doc_id", "_row", "epoch"], "size", "_step", 2 * cells, "_total"
    )
    # Truncate at the budget: what would pass it is cut to the words that are left.
    words = F.greatest(F.lit(0), F.least(F.col("size"), F.lit(budget) - (F.col("_total") - F.col("size")))).cast("long")
    copies = served.select("_row", "size", "epoch", "finish", words.alias("words")).filter("words > 0")
    return rows.select("_row", "doc_id", "size", "source_size", "target"), copies


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row for each document."""
    rows, copies = queue_copies(docs, **options)
    taken = copies.groupBy("_row").agg(F.sum("words").alias("taken"))
    taken_words = F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    return rows.join(taken, "_row", "left").select("doc_id", "size", "source_size", "target", taken_words)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the input's columns, one row for each copy served, under its old doc_id.

    The one copy that the budget cuts keeps its first words.
    """
    name, count = free_name(docs, "row"), free_name(docs, "words")
    whole = numbered(docs, name)
    _, copies = queue_copies(whole, row_col=name, **options)
    served = copies.select(F.col("_row").alias(name), F.when(F.col("words") < F.col("size"), F.col("words")).alias(count))
    joined = whole.join(served, name)
    words = F.regexp_extract_all(text_of("text"), F.lit(f"({WORD})"), 1)
    cut = F.array_join(F.slice(words, F.lit(1), F.col(count).cast("int")), " ")
    text = F.when(F.col(count).isNotNull(), cut).otherwise(F.col("text"))
    return joined.select(*[text.alias("text") if n == "text" else c for n, c in zip(docs.columns, columns_of(docs))])
