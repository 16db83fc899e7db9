"""Output contracts: what a result must look like, checked in one pass over it."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class ValueRule:
    min: float | None = None
    max: float | None = None
    allowed: tuple = ()
    unique: bool = False


@dataclass(frozen=True)
class Contract:
    rows: tuple[int | None, int | None] | None = None
    required: tuple[str, ...] = ()
    non_null: tuple[str, ...] = ()
    values: dict[str, ValueRule] = field(default_factory=dict)
    order: dict[str, str] = field(default_factory=dict)

    @property
    def declared(self) -> int:
        return bool(self.rows) + bool(self.required) + bool(self.non_null) + len(self.values) + len(self.order)


@dataclass(frozen=True)
class Verdict:
    passed: bool
    failures: tuple[str, ...]
    score: float


def _number(x) -> float | None:
    return x if isinstance(x, (int, float)) and not isinstance(x, bool) else None


def _names(x) -> tuple[str, ...]:
    return tuple(c for c in x if isinstance(c, str)) if isinstance(x, list) else ()


def parse_contract(text: str) -> Contract:
    """A contract from JSON, in a code fence or not; what does not fit is left out, junk is an empty contract."""
    body = re.sub(r"^\s*```[a-zA-Z]*\s*|\s*```\s*$", "", text or "")
    start, end = body.find("{"), body.rfind("}")
    try:
        d = json.loads(body[start : end + 1])
    except ValueError:
        return Contract()
    if not isinstance(d, dict):
        return Contract()
    span = d.get("expected_rows_range")
    rows = tuple(int(x) if _number(x) is not None else None for x in span) if isinstance(span, list) and len(span) == 2 else None
    values = {}
    for name, r in (d.get("value_constraints") or {}).items() if isinstance(d.get("value_constraints"), dict) else ():
        if isinstance(r, dict):
            allowed = r.get("allowed_values")
            values[name] = ValueRule(_number(r.get("min")), _number(r.get("max")), tuple(allowed) if isinstance(allowed, list) else (), r.get("must_be_unique") is True)
    order = {c: o for c, o in d["monotonicity"].items() if o in ("asc", "desc")} if isinstance(d.get("monotonicity"), dict) else {}
    return Contract(rows, _names(d.get("required_columns")), _names(d.get("non_null_columns")), values, order)


def _real(df: DataFrame, name: str) -> str | None:
    """The column of that name, capitals aside."""
    return next((c for c in df.columns if c.lower() == name.lower()), None)


def _quoted(name: str):
    return F.col(f"`{name}`")


def _breaks(df: DataFrame, order: dict[str, str], order_by: str | None) -> dict[str, int]:
    """For each column how many rows fall back behind the row before: by ``order_by``, else in the frame's own order.

    A frame's own order is that of its partitions, which is what a sorted frame
    is collected in. Each task compares its rows and hands on its first and last
    values; only these, one row a task, are compared on the driver.
    """
    frame = (df.orderBy(order_by) if order_by else df).select(*[_quoted(c) for c in order])
    kinds = [f.dataType for f in frame.schema]
    names = list(order)
    schema = T.StructType([T.StructField("part", T.IntegerType()), *[T.StructField(f"{k}{i}", t) for i, t in enumerate(kinds) for k in ("first", "last")], *[T.StructField(f"n{i}", T.LongType()) for i in range(len(kinds))]])

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        first, last, n = None, None, [0] * len(names)
        for batch in batches:
            if not batch.num_rows:
                continue
            for i, name in enumerate(names):
                x = batch.column(i)
                whole = pa.concat_arrays([last[i], x]) if last else x
                n[i] += fallen(whole, order[name])
            first = first or [batch.column(i).slice(0, 1) for i in range(len(names))]
            last = [batch.column(i).slice(batch.num_rows - 1, 1) for i in range(len(names))]
        if first:
            ends = [v[i] for i in range(len(names)) for v in (first, last)]
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), *ends, *[pa.array([k], pa.int64()) for k in n]], names=[f.name for f in schema])

    rows = sorted(frame.mapInArrow(run, schema).collect(), key=lambda r: r["part"])
    out = {}
    for i, name in enumerate(names):
        falls = sum(r[f"n{i}"] for r in rows)
        falls += sum(_falls(a[f"last{i}"], b[f"first{i}"], order[name]) for a, b in zip(rows, rows[1:]))
        out[name] = falls
    return out


def _falls(before, after, way: str) -> bool:
    """Nulls stand first in either direction."""
    if before is None or after is None:
        return after is None and before is not None
    return after < before if way == "asc" else after > before


def fallen(x, way: str) -> int:
    """How many values of an Arrow array fall back behind the one before."""
    import pyarrow.compute as pc

    if len(x) < 2:
        return 0
    a, b = x.slice(0, len(x) - 1), x.slice(1)
    back = pc.less(b, a) if way == "asc" else pc.greater(b, a)
    nulls = pc.and_(pc.is_null(b), pc.is_valid(a))
    return pc.sum(pc.or_(pc.fill_null(back, False), nulls)).as_py() or 0


def measures(df: DataFrame, contract: Contract, order_by: str | None = None) -> dict:
    """All numbers that the contract needs, from one aggregation (and one pass in order for monotonic columns)."""
    aggs = {"rows": F.count(F.lit(1))}
    for c in df.columns:
        aggs[f"nulls:{c}"] = F.count_if(_quoted(c).isNull())
    kinds = {f.name: f.dataType for f in df.schema}
    for name, rule in contract.values.items():
        if c := _real(df, name):
            x = _quoted(c)
            if rule.min is not None or rule.max is not None:
                aggs[f"min:{c}"], aggs[f"max:{c}"] = F.min(x), F.max(x)
            if rule.allowed:
                same = [v for v in rule.allowed if _comparable(v, kinds[c])]
                aggs[f"other:{c}"] = F.count_if(x.isNotNull() & ~x.isin(same)) if same else F.count(x)
            if rule.unique:
                aggs[f"distinct:{c}"] = F.count_distinct(x) + F.max(F.when(x.isNull(), 1).otherwise(0))
    names = list(aggs)
    row = df.agg(*[aggs[n].alias(f"m{i}") for i, n in enumerate(names)]).first()
    out = {n: row[i] for i, n in enumerate(names)}
    order = {c: way for name, way in contract.order.items() if (c := _real(df, name))}
    return out | ({f"back:{c}": n for c, n in _breaks(df, order, order_by).items()} if order else {})


def _comparable(value, kind: T.DataType) -> bool:
    if isinstance(kind, T.StringType):
        return isinstance(value, str)
    if isinstance(kind, T.BooleanType):
        return isinstance(value, bool)
    return not isinstance(kind, T.NumericType) or _number(value) is not None


def _limits(c: str, rule: ValueRule, m: dict, n: int) -> list[str]:
    """The rule's failures, in order; where values cannot be compared with a limit, that and what follows is skipped."""
    out: list[str] = []
    try:
        if rule.min is not None and m[f"min:{c}"] is not None and m[f"min:{c}"] < rule.min:
            out.append(f"value_min[{c}]: {m[f'min:{c}']} is under {rule.min}")
        if rule.max is not None and m[f"max:{c}"] is not None and m[f"max:{c}"] > rule.max:
            out.append(f"value_max[{c}]: {m[f'max:{c}']} is over {rule.max}")
        if rule.allowed and m[f"other:{c}"]:
            out.append(f"value_allowed[{c}]: {m[f'other:{c}']} rows have other values")
        if rule.unique and m[f"distinct:{c}"] != n:
            out.append(f"value_unique[{c}]: {m[f'distinct:{c}']} values in {n} rows")
    except TypeError:
        pass
    return out


def failures(df: DataFrame, contract: Contract, order_by: str | None = None) -> list[str]:
    m = measures(df, contract, order_by)
    n, out = m["rows"], []
    if contract.rows:
        lo, hi = contract.rows
        if lo is not None and n < lo:
            out.append(f"rows_range: {n} rows, at least {lo} expected")
        elif hi is not None and n > hi:
            out.append(f"rows_range: {n} rows, at most {hi} expected")
    if missing := [c for c in contract.required if not _real(df, c)]:
        out.append(f"required_columns: missing {', '.join(missing)}")
    holes = [c for c in contract.non_null if (r := _real(df, c)) and m[f"nulls:{r}"]]
    if holes:
        out.append(f"non_null: nulls in {', '.join(holes)}")
    for name, rule in contract.values.items() if n else ():
        if c := _real(df, name):
            out += _limits(c, rule, m, n)
    for name, way in contract.order.items():
        c = _real(df, name)
        if c and n > 1 and m.get(f"back:{c}"):
            out.append(f"monotonicity[{c}]: not {way}")
    return out


def verify(df: DataFrame, contract: Contract, order_by: str | None = None) -> Verdict:
    """The score may fall below 0: each failure of its own kind counts against the rules declared."""
    if not contract.declared:
        return Verdict(True, (), 100.0)
    found = failures(df, contract, order_by)
    kinds = {f.split(":", 1)[0] for f in found}
    return Verdict(not found, tuple(found), round(100.0 * (contract.declared - len(kinds)) / contract.declared, 2))


def all_null_columns(df: DataFrame) -> DataFrame:
    """name: columns of a non-empty table that hold nothing."""
    counted = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(_quoted(c)).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), _quoted(c).alias("k")) for c in df.columns])
    return counted.select("_n", F.explode(pairs).alias("p")).filter("_n > 0 and p.k = 0").select(F.col("p.name").alias("name"))


#: Names that stand for whole tables of another kind than the query's, where values are asked for.
IDIOM = r"(?i)\bcollect\s*\(\s*\)|is_in\s*\([^)]*\.lazy\s*\("


def check_semantics(df: DataFrame, text: str = "") -> Verdict:
    """Two layers, the first that fails counts: columns that hold nothing, then turns of phrase that do not carry over."""
    empty = [r[0] for r in all_null_columns(df).collect()]
    found = (f"all_null: {', '.join(empty)}",) if empty else ()
    if not found and re.search(IDIOM, text):
        found = ("idiom: the query calls what is no function of SQL",)
    return Verdict(not found, found, 0.0 if found else 100.0)


def contract_for(request: str, schema: str, ask: Callable[[str], str]) -> Contract:
    """A contract from a request, by a model: ``ask`` gets the instruction and gives JSON. Whatever fails, the contract is empty and claims nothing."""
    try:
        return parse_contract(ask(CONTRACT_PROMPT.format(schema=schema, request=request)))
    except Exception:
        return Contract()


CONTRACT_PROMPT = """Read the request and say what any right result must look like. Claim only what the request and the schema make certain.

Schema:
{schema}

Request: {request}

Answer with one JSON object and nothing else. All keys may be left out:
expected_rows_range: [least, most], either may be null
required_columns, non_null_columns: lists of names
value_constraints: {{name: {{min, max, allowed_values, must_be_unique}}}}
monotonicity: {{name: "asc" or "desc"}}"""
