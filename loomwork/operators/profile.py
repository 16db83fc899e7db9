"""Profiles of tables and unions of tables whose schemas differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLES = 5
MOST_SAMPLED = 500
UNIFIED_ROWS = 1_000


def nulls(df: DataFrame) -> DataFrame:
    """name, n_rows, n_nulls: one row a column, from one pass."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("n")) for c in df.columns])
    return one.select("_n", F.explode(pairs).alias("p")).select("p.name", F.col("_n").alias("n_rows"), F.col("p.n").alias("n_nulls"))


def samples(df: DataFrame, order: str, n: int = SAMPLES) -> DataFrame:
    """name, samples: the first values of each column that are not null, as text.

    Every column keeps its own n smallest places; partial results stay that small.
    """
    names = df.columns[:MOST_SAMPLED]
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("v")) for c in names])
    rows = df.select(F.col(order).alias("_o"), F.explode(cells).alias("p")).filter("p.v is not null")
    from pyspark.sql import Window

    w = Window.partitionBy("p.name").orderBy("_o")
    top = rows.withColumn("_nr", F.row_number().over(w)).filter(F.col("_nr") <= n)
    return top.groupBy(F.col("p.name").alias("name")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_nr", "p.v"))), lambda x: x["v"]).alias("samples"))


def bytes_of(kind: T.DataType) -> int:
    """Estimated bytes of a value of that type."""
    sizes = [(T.BooleanType, 1), (T.ByteType, 1), (T.ShortType, 2), (T.IntegerType, 4), (T.FloatType, 4), (T.LongType, 8), (T.DoubleType, 8), (T.StringType, 50)]
    return next((n for t, n in sizes if isinstance(kind, t)), 8)


def size_mb(schema: T.StructType, n_rows: int) -> float:
    return sum(bytes_of(f.dataType) for f in schema) * n_rows / 2**20


_NUMBERS = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType()]


def supertype(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that holds both: the wider number, timestamp over date, else text."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if a in _NUMBERS and b in _NUMBERS:
        wide = max(a, b, key=_NUMBERS.index)
        narrow = min(a, b, key=_NUMBERS.index)
        return T.DoubleType() if wide == T.FloatType() and narrow in _NUMBERS[2:4] else wide
    days = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(a, days) and isinstance(b, days):
        return a if isinstance(b, T.DateType) else b if isinstance(a, T.DateType) else T.TimestampType()
    if isinstance(a, T.BooleanType) and b in _NUMBERS:
        return b
    if isinstance(b, T.BooleanType) and a in _NUMBERS:
        return a
    return T.StringType()


def union_relaxed(frames: list[DataFrame]) -> DataFrame:
    """Union by name: absent columns are null, conflicting types become one that holds both, repeats stay."""
    if not frames:
        raise ValueError("nothing to unite")
    kinds: dict[str, T.DataType] = {}
    for df in frames:
        for f in df.schema:
            kinds[f.name] = supertype(kinds[f.name], f.dataType) if f.name in kinds else f.dataType

    def fit(df: DataFrame) -> DataFrame:
        have = set(df.columns)
        return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])

    return reduce(lambda a, b: a.unionByName(b), [fit(df) for df in frames])


def merge_label(n_sources: int, named: bool) -> str:
    return "multi_table_join" if named else "single_source" if n_sources == 1 else "concat_diagonal"


def schema_warnings(frames: list[DataFrame]) -> list[str]:
    """How later tables differ from the first."""
    out = []
    first = {f.name: f.dataType for f in frames[0].schema} if frames else {}
    for i, df in enumerate(frames[1:], 2):
        here = {f.name: f.dataType for f in df.schema}
        if missing := sorted(set(first) - set(here)):
            out.append(f"table {i} lacks {', '.join(missing)}")
        if extra := sorted(set(here) - set(first)):
            out.append(f"table {i} also has {', '.join(extra)}")
        out += [f"table {i} has {c} as {here[c].simpleString()}, not {first[c].simpleString()}" for c in sorted(set(first) & set(here)) if first[c] != here[c]]
    return out


def unified_profile(df: DataFrame, rows: int = UNIFIED_ROWS) -> dict:
    """Schema, exact row count, and null counts of a stated number of first rows."""
    part = df.limit(rows)
    found = {r["name"]: r["n_nulls"] for r in nulls(part).collect()}
    total = df.count()
    return {"columns": {f.name: f.dataType.simpleString() for f in df.schema}, "total_rows": total, "sample_rows": min(rows, total), "null_counts": found, "size_mb": size_mb(df.schema, total)}
