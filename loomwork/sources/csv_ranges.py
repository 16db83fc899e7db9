"""CSV whose quoted values hold line ends, read in ranges of bytes.

Whether a line ends inside of a value depends on whether it begins inside of one,
so a line is a function of two states, and so is a range of lines: it leaves the
state as it is, turns it over, or ends in one state whatever it began in. A first
pass finds the function of each range; composed in the file's order they tell
each range whether it begins inside of a value. (Counting quotes would do, if
values that are not quoted never held one.) A second pass cuts every range into
records from its first true record start on. What a range holds of a record that
began before it, and a record that runs beyond its end, are put together by key:
two pieces a range at most. Ranges are those of Spark's text source, so a file of
any size is read by as many tasks as it has ranges, and no task reads a whole one.

On the driver there are only the ranges that begin inside of a value.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.runtime import discard, kept

QUOTE = ord('"')
#: Kinds of pieces: the rest of a record that began in an earlier range, a whole record, one that runs on.
REST, WHOLE, OPEN = 0, 1, 2


def lines(spark: SparkSession, path: str, line_end: str) -> DataFrame:
    """value, file, start: the lines of all files with the range they stand in."""
    text = spark.read.option("lineSep", line_end).text(path)
    return text.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def after(line: bytes, inside: bool, separator: int) -> bool:
    """Whether the line ends inside of a quoted value. A quote opens a value at its start only; one before a separator or the end closes it, two are one of the value's own."""
    if QUOTE not in line:
        return inside
    line, at = line.removesuffix(b"\r"), 0
    while True:
        if not inside:
            if at < len(line) and line[at] == QUOTE:
                inside, at = True, at + 1
            else:
                at = line.find(separator, at) + 1
                if not at:
                    return False
                continue
        at = line.find(QUOTE, at)
        if at < 0:
            return True
        follows = line[at + 1] if at + 1 < len(line) else None
        if follows is None:
            return False
        inside, at = follows != separator, at + (1 if follows not in (QUOTE, separator) else 2)


def functions(found: DataFrame, separator: int) -> DataFrame:
    """file, start, from_out, from_in, broken: the state after each range that has quotes, from either state, and whether a line between records ends inside of a value."""

    def run(batches):
        at, rows = None, []
        for batch in batches:
            for value, file, start in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                if at != (file, start):
                    if at:
                        rows.append((*at, out, in_, broken))
                    at, out, in_, broken = (file, start), False, True, False
                one, two = after(value, False, separator), after(value, True, separator)
                broken |= one
                out, in_ = (two if out else one), (two if in_ else one)
        if at:
            rows.append((*at, out, in_, broken))
            kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["file", "start", "from_out", "from_in", "broken"])

    quoted = found.filter(F.contains(F.col("value"), F.lit(bytes([QUOTE]))))
    return quoted.mapInArrow(run, "file string, start long, from_out boolean, from_in boolean, broken boolean")


def begin_inside(found: DataFrame, known: DataFrame) -> DataFrame:
    """file, start of the ranges that begin inside of a value."""
    every = found.groupBy("file", "start").agg(F.lit(1).alias("_")).drop("_").join(known, ["file", "start"], "left")
    order = Window.partitionBy("file").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = every.withColumn("turn", (F.col("from_out") & ~F.col("from_in")).cast("int")).withColumn("turned", F.sum(F.coalesce("turn", F.lit(0))).over(order))
    # the last range before that ends in one state whatever it began in, and how often the state was turned over since
    fixed = F.when(F.col("from_out") == F.col("from_in"), F.struct("from_out", "turned"))
    last, so_far = F.last(fixed, ignorenulls=True).over(before), F.coalesce(F.max("turned").over(before), F.lit(0))
    state = turns.withColumn("last", last).withColumn("so_far", so_far)
    inside = F.coalesce(F.col("last.from_out"), F.lit(False)) != ((F.col("so_far") - F.coalesce("last.turned", F.lit(0))) % 2 == 1)
    return state.filter(inside).select("file", "start")


def _pieces(found: DataFrame, inside: frozenset[tuple[str, int]], charset: str, line_end: str, separator: int) -> DataFrame:
    """file, start, nr, kind, closed, text: the records of each range and its pieces of others."""
    end = line_end.encode()

    def run(batches):
        at, held, kind, nr = None, [], WHOLE, 0

        def piece(closed: bool):
            nonlocal held, nr
            text = end.join(held)
            if closed and text.endswith(b"\r"):
                text = text[:-1]
            row = (*at, nr, kind if closed or kind == REST else OPEN, closed, text.decode(charset, "replace"))
            held, nr = [], nr + 1
            return row

        for batch in batches:
            out = []
            for value, file, start in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                if at != (file, start):
                    if held:
                        out.append(piece(False))
                    at, nr, open_ = (file, start), 0, (file, start) in inside
                    kind = REST if open_ else WHOLE
                held.append(value)
                open_ = after(value, open_, separator)
                if not open_:
                    out.append(piece(True))
                    kind = WHOLE
            if out:
                yield _batch(out)
        if held:
            yield _batch([piece(False)])

    return found.mapInArrow(run, "file string, start long, nr long, kind int, closed boolean, text string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["file", "start", "nr", "kind", "closed", "text"])


def records(spark: SparkSession, path: str, charset: str, separator: str, line_end: str = "\n") -> DataFrame | None:
    """text: every record but each file's first one; None if no line ends inside of a value, so that lines are records."""
    found, sign = lines(spark, path, line_end), ord(separator)
    known = kept(functions(found, sign), "ranges")
    if known.filter("broken").isEmpty():
        discard(known)
        return None
    inside = frozenset((r.file, r.start) for r in begin_inside(found, known).collect())
    discard(known)
    pieces = _pieces(found, inside, charset, line_end, sign).filter(~((F.col("start") == 0) & (F.col("nr") == 0) & (F.col("kind") == WHOLE)))
    whole = pieces.filter(F.col("kind") == WHOLE).select("text")
    # pieces of one record follow each other: it opens in one range and goes on in the next ones
    order = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    split = pieces.filter(F.col("kind") != WHOLE).withColumn("of", F.sum((F.col("kind") == OPEN).cast("long")).over(order))
    parts = split.groupBy("file", "of").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "nr", "text"))).alias("p"))
    # a first record that runs on over a range is the header too
    header = (F.col("p")[0]["start"] == 0) & (F.col("p")[0]["nr"] == 0)
    joined = parts.filter(~header).select(F.array_join(F.transform("p", lambda x: x["text"]), line_end).alias("text"))
    return whole.unionByName(joined).filter(F.trim("text") != "")


def parsed(found: DataFrame, columns: list[str], separator: str) -> DataFrame:
    """The columns of the records, all text. A record of another number of values is an error."""
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    options = {"sep": separator, "escape": '"', "nullValue": "", "mode": "FAILFAST", "multiLine": "true", "maxCharsPerColumn": "-1"}
    return found.select(F.from_csv("text", F.lit(schema), options).alias("r")).select("r.*")
