"""Column helpers where the engine's semantics differ from Spark's defaults, each in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.runtime import pin


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sum0(x: str | Column) -> Column:
    """Sum that is 0, not null, where nothing is summed."""
    return F.coalesce(F.sum(_c(x)), F.lit(0))


def n_unique(x: str | Column) -> Column:
    """Distinct values; null counts as one of them."""
    return F.count_distinct(_c(x)) + F.max(F.when(_c(x).isNull(), 1).otherwise(0))


def null_count(x: str | Column) -> Column:
    return F.count_if(_c(x).isNull())


def first_by(x: str | Column, order: str | Column) -> Column:
    """The value in the first row of an explicit order; bare first() has none."""
    return F.min_by(_c(x), _c(order))


def last_by(x: str | Column, order: str | Column) -> Column:
    return F.max_by(_c(x), _c(order))


def rank_average(value: str, *keys: str) -> Column:
    """Rank within keys, ties share the mean of their places; null has no rank."""
    part = Window.partitionBy(*keys)
    place = F.rank().over(part.orderBy(F.col(value).asc_nulls_last())).cast("double")
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return F.when(F.col(value).isNotNull(), place + (ties - 1) / 2.0)


def running_total(value: str, keys: list[str], order: list[str]) -> Column:
    """Sum up to this row, row by row; a null stays null."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.when(F.col(value).isNotNull(), F.sum(value).over(w))


def nulls_first(name: str, descending: bool = False) -> Column:
    """A sort key with nulls first in either direction."""
    return F.col(name).desc_nulls_first() if descending else F.col(name).asc_nulls_first()


def divide(a: str | Column, b: str | Column) -> Column:
    """True division in floating point: x/0 is an infinity, 0/0 is NaN, and nothing throws."""
    x, y = _c(a).cast("double"), _c(b).cast("double")
    at_zero = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))).when(x == 0, F.lit(float("nan")))
    return F.when(y == 0, at_zero).otherwise(F.try_divide(x, y))


def contains(x: str | Column, values: list) -> Column:
    return _c(x).isin(values) if values else F.when(_c(x).isNotNull(), F.lit(False))


def join_tables(left: DataFrame, right: DataFrame, left_on: str, right_on: str, how: str = "inner", coalesce: bool | None = None, suffix: str = "_right") -> DataFrame:
    """Equi-join with the engine's rules for keys and clashing names.

    The right key goes unless ``coalesce`` is False (for full joins it is kept
    unless ``coalesce`` is True, when both keys become one). Other names of the
    right side that clash get ``suffix``.
    """
    full = how in ("outer", "full")
    merge = (not full) if coalesce is None else coalesce
    taken = set(left.columns)
    renamed = right
    new_key = right_on
    for name in right.columns:
        if name in taken:
            renamed = renamed.withColumnRenamed(name, name + suffix)
            new_key = name + suffix if name == right_on else new_key
    joined = left.join(renamed, left[left_on] == renamed[new_key], "full" if full else how)
    if not merge:
        return joined
    if full:
        joined = joined.withColumn(left_on, F.coalesce(left[left_on], renamed[new_key]))
    return joined.drop(new_key)


def with_row_number(df: DataFrame, order: list[Column], name: str = "row_nr") -> DataFrame:
    """Numbers rows in an explicit order. Rows are sorted by range and numbered inside their partitions; only the partitions' sizes are added up."""
    rows = pin(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))  # one row a partition
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(offsets), part == F.col("_part")).withColumn(name, inside + F.col("_ahead")).drop("_at", "_part", "_ahead")


def head(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    return df.orderBy(*order).limit(n)


def slice_rows(df: DataFrame, order: list[Column], offset: int, length: int) -> DataFrame:
    """Rows ``offset`` to ``offset + length`` of an explicit order, found without numbering what lies beyond them."""
    return df.orderBy(*order).limit(offset + length).offset(offset)
