"""Running queries that were written elsewhere: only reading ones, only over given tables, with retries."""

from __future__ import annotations

import contextlib
import difflib
import re
import threading
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession

from loomwork.operators.contracts import Contract, Verdict, check_semantics, verify
from loomwork.sources.tabular import view_names

# Functions that reach outside the data.
DENIED = ["reflect", "java_method", "try_reflect", "read_files", "input_file_name", "current_user", "session_user"]
#: Roots of plans that only read.
READING = ["Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Limit", "Distinct", "Union", "Join", "Window", "WithCTE", "UnresolvedWith", "SubqueryAlias", "UnresolvedHaving", "Intersect", "Except", "Offset", "UnresolvedInlineTable", "LocalRelation", "OneRowRelation", "Pivot", "Unpivot", "UnresolvedSubqueryColumnAliases"]
#: Nodes of analysed plans that read nothing themselves; a given table is a view, and nothing below it is looked at.
KNOWN = frozenset(
    ["Project", "Filter", "Join", "LateralJoin", "Aggregate", "Expand", "Window", "Generate", "Sort", "GlobalLimit", "LocalLimit", "Limit", "Offset", "Distinct", "Deduplicate", "Union", "Intersect", "Except"]
    + ["SubqueryAlias", "WithCTE", "CTERelationDef", "CTERelationRef", "UnionLoop", "UnionLoopRef", "LocalRelation", "OneRowRelation", "Pivot", "Unpivot", "Sample", "ResolvedHint"]
)
#: What makes rows of a row's values.
GENERATORS = frozenset(["Explode", "PosExplode", "Inline", "Stack", "JsonTuple", "VariantExplode"])
#: Expressions that reach outside the data, or run code that is not Spark's own, whatever name they were called by.
OUTSIDE = frozenset(
    ["CallMethodViaReflection", "TryReflect", "InputFileName", "InputFileBlockStart", "InputFileBlockLength", "CurrentUser", "SessionUser", "CurrentDatabase", "CurrentCatalog"]
    + ["ScalaUDF", "PythonUDF", "PythonUDAF", "PythonUDTF", "HiveSimpleUDF", "HiveGenericUDF", "HiveUDAFFunction", "HiveGenericUDTF", "ApplyFunctionExpression", "ScalaAggregator", "ScalaUDAF"]
)

#: How long a generated query may take.
SECONDS = 300.0


class Rejected(ValueError):
    """A query that is not run."""


class TimeLimit(RuntimeError):
    """A query that took too long."""


def _items(seq) -> list:
    """A Scala sequence as a list."""
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _unknown_tables(plan, known: frozenset[str]) -> list[str]:
    """Names that a parsed plan reads and that are neither given nor defined by the query, each looked up where it stands."""
    kind = _kind(plan)
    if kind == "UnresolvedRelation":
        name = ".".join(_items(plan.multipartIdentifier()))
        return [] if name.lower() in known else [name]
    if kind == "UnresolvedWith":
        inner, out = known, []
        for pair in _items(plan.cteRelations()):
            name, body = pair._1().lower(), pair._2()
            out += _unknown_tables(body, inner | {name} if plan.allowRecursion() else inner)
            inner |= {name}
        return out + _unknown_tables(plan.child(), inner)
    below = _items(plan.children()) + _items(plan.subqueries())
    return [n for p in below for n in _unknown_tables(p, known)]


def check_sql(spark: SparkSession, text: str, tables: Iterable[str] | None = None) -> str:
    """The class of the plan's root, if the query only reads: no file paths, no functions that reach outside, and of relations
    only views of the given ``tables`` and what the query defines itself. None: relations are not looked at."""
    if len(text) > 100_000:
        raise Rejected("the query is too long")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise Rejected(f"the query does not parse: {str(e).splitlines()[0][:300]}") from e
    root = _kind(plan)
    if root not in READING:
        raise Rejected(f"{root} does more than read")
    bare = re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", "''", re.sub(r"--[^\n]*|/\*.*?\*/", " ", text, flags=re.S))
    for name in DENIED:
        if re.search(rf"\b{name}\b\s*\(", bare, re.I):
            raise Rejected(f"{name} is not allowed")
    if re.search(r"\b(parquet|csv|json|orc|text|binaryfile|avro|delta)\s*\.\s*`", bare, re.I):
        raise Rejected("files are not read by path")
    if tables is not None and (unknown := _unknown_tables(plan, frozenset(t.lower() for t in tables))):
        raise Rejected(f"not among the given tables: {', '.join(sorted(set(unknown)))}")
    return root


def _moved(df_plan, session: SparkSession) -> DataFrame:
    """A frame of the analysed plan in another session."""
    rows = session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, df_plan)
    return DataFrame(rows, session)


def alone(spark: SparkSession, tables: dict[str, DataFrame]) -> SparkSession:
    """A session of its own, with the same settings, in which only views of the given tables exist and no file is a table."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    for i, (name, view) in enumerate(view_names(tables).items()):
        here = _moved(tables[name]._jdf.queryExecution().analyzed(), own)
        here.createOrReplaceTempView(view)
        if not i:
            here.createOrReplaceTempView("df")
    return own


def _expressions(plan):
    held = _items(plan.expressions())
    while held:
        e = held.pop()
        yield e
        held += _items(e.children())


def check_analysed(plan, views: frozenset[str]) -> None:
    """Whether all that an analysed plan reads are the given views: every other node must be KNOWN, so what is not on the list
    (a table of the catalog, a table function, a file) is refused, whatever name or expression it was found by."""
    kind = _kind(plan)
    if kind == "View":
        name = plan.desc().identifier().unquotedString()
        if not plan.isTempView() or name.lower() not in views:
            raise Rejected(f"not among the given tables: {name}")
        return
    if kind not in KNOWN:
        raise Rejected(f"{kind} reads something else than the given tables")
    if kind == "Generate" and _kind(plan.generator()) not in GENERATORS:
        raise Rejected(f"{plan.generator().prettyName()} is not allowed")
    for e in _expressions(plan):
        if _kind(e) in OUTSIDE:
            raise Rejected(f"{e.prettyName()} is not allowed")
    for below in _items(plan.children()) + _items(plan.subqueries()) + _items(plan.innerChildren()):
        if hasattr(below, "expressions"):
            check_analysed(below, views)


def run_sql(spark: SparkSession, tables: dict[str, DataFrame], text: str) -> DataFrame:
    """The query's result over views df_<name> of the tables (df: the first). It is analysed where nothing else exists, and what it
    has become is checked before anything runs; no view is left in the caller's session."""
    views = [*view_names(tables).values(), "df"] if tables else []
    check_sql(spark, text, views)
    own = alone(spark, tables)
    try:
        plan = own.sql(text)._jdf.queryExecution().analyzed()
    except AnalysisException as e:
        if (e.getCondition() or "").startswith("TABLE_OR_VIEW_NOT_FOUND"):
            raise Rejected(f"not among the given tables: {str(e).splitlines()[0][:300]}") from e
        raise
    check_analysed(plan, frozenset(v.lower() for v in views))
    return _moved(plan, spark)


@dataclass(frozen=True)
class Diagnosis:
    kind: str
    message: str
    suggestion: str = ""
    recoverable: bool = True


# What Spark's error conditions mean for the writer of a query.
CONDITIONS = {
    "UNRESOLVED_COLUMN": ("column_not_found", "use a column that the table has; names are case-sensitive"),
    "TABLE_OR_VIEW_NOT_FOUND": ("table_not_found", "use one of the given tables"),
    "CAST_INVALID_INPUT": ("type_mismatch", "cast with try_cast or clean the values first"),
    "DATATYPE_MISMATCH": ("type_mismatch", "cast the operands to one type"),
    "DIVIDE_BY_ZERO": ("arithmetic", "divide with try_divide"),
    "AMBIGUOUS_REFERENCE": ("join_key", "name the table of a column that both sides have"),
    "MISSING_AGGREGATION": ("aggregation", "group by the column or aggregate it"),
    "PARSE_SYNTAX_ERROR": ("syntax_error", "write one SELECT statement"),
    "UNRESOLVED_ROUTINE": ("function_not_found", "use a function of Spark SQL"),
}


# What other dialects write and Spark SQL does not.
FOREIGN = [
    (r"\bSELECT\s+TOP\s+\d+", "SELECT TOP n", "LIMIT n"),
    (r"\bILIKE\s+ANY\b|~\*", "~*", "RLIKE"),
    (r"::\s*text\b", "::text", "CAST(x AS STRING)"),
    (r"\bdf\s*\[|\.groupby\s*\(|\.i?loc\s*\[", "data frame code", "one SELECT statement"),
]


def _near(name: str, columns: list[str]) -> tuple[str, str]:
    """(kind, suggestion) for a column that is not there."""
    alike = next((c for c in columns if c.lower() == name.lower()), None)
    if alike:
        return "case_mismatch", f"names are case-sensitive: use {alike}, not {name}"
    close = difflib.get_close_matches(name, columns, 1, 0.7)
    return "column_not_found", f"did you mean {close[0]}?" if close else "use a column that the table has"


def _dropped_key(text: str, name: str) -> bool:
    """Whether the name is a right key of a join USING another spelling, or of a semi or anti join, which keep the left side only."""
    return bool(re.search(rf"\b(semi|anti)\s+join\b[^;]*\b{re.escape(name)}\b", text, re.I))


def diagnose(error: Exception, text: str = "") -> Diagnosis:
    """What went wrong and how to mend it, from Spark's error condition; ``text``: the query."""
    said = str(error).splitlines()[0][:500] if str(error) else type(error).__name__
    if isinstance(error, Rejected):
        for pattern, wrong, right in FOREIGN:
            if re.search(pattern, text, re.I):
                return Diagnosis("foreign_syntax", said, f"Spark SQL has no {wrong}; use {right}")
        if not text.strip():
            return Diagnosis("missing_result", "no query was given", "answer with one SELECT statement")
        return Diagnosis("rejected", said, "write a query that only reads the given tables")
    if isinstance(error, TimeLimit):
        return Diagnosis("timeout", said, "read less or aggregate earlier")
    condition = (error.getCondition() or "") if isinstance(error, PySparkException) else ""
    if condition.startswith("UNRESOLVED_COLUMN"):
        given = error.getMessageParameters() or {}
        name = given.get("objectName", "").replace("`", "").rsplit(".", 1)[-1]
        columns = re.findall(r"`([^`]+)`(?=,|$|\])", given.get("proposal", ""))
        if _dropped_key(text, name):
            return Diagnosis("join_key", said, f"a semi or anti join keeps the left side only: {name} is not in its result")
        return Diagnosis(*(lambda kind, hint: (kind, said, hint))(*_near(name, columns)))
    for name, (kind, suggestion) in CONDITIONS.items():
        if condition.startswith(name) or f"[{name}" in said:
            return Diagnosis(kind, said, suggestion)
    return Diagnosis("unknown", said)


@dataclass
class Attempt:
    text: str
    diagnosis: Diagnosis | None = None
    verdict: Verdict | None = None


@dataclass
class Outcome:
    result: DataFrame | None
    #: The text that gave the result; after repairs not the first one.
    text: str | None
    attempts: list[Attempt] = field(default_factory=list)


@contextlib.contextmanager
def time_limit(spark: SparkSession, seconds: float | None):
    """Jobs that this block starts are cancelled after ``seconds``; what then fails is a TimeLimit."""
    tag = uuid.uuid4().hex
    late = threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop) if seconds else None
    spark.sparkContext.addJobTag(tag)
    if timer:
        timer.daemon = True
        timer.start()
    try:
        yield
    except Exception as e:
        if late.is_set():
            raise TimeLimit(f"stopped after {seconds:g} seconds") from e
        raise
    finally:
        if timer:
            timer.cancel()
        spark.sparkContext.removeJobTag(tag)


def run_with_retries(
    spark: SparkSession, tables: dict[str, DataFrame], generate: Callable[[list[Attempt]], str], contract: Contract | None = None, retries: int = 3, order_by: str | None = None, seconds: float | None = SECONDS
) -> Outcome:
    """Asks for a query, runs it, checks the result, and asks again with what went wrong."""
    attempts: list[Attempt] = []
    for _ in range(retries + 1):
        text = generate(attempts)
        try:
            with time_limit(spark, seconds):
                df = run_sql(spark, tables, text)
                verdict = check_semantics(df, text)
                if verdict.passed and contract:
                    verdict = verify(df, contract, order_by)
        except Exception as e:
            attempts.append(Attempt(text, diagnosis=diagnose(e, text)))
            continue
        attempts.append(Attempt(text, verdict=verdict))
        if verdict.passed:
            return Outcome(df, text, attempts)
    return Outcome(None, None, attempts)
