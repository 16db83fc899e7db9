"""Scores and classifications of answers and runs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The operations that programs are searched for, error classes in order with their signs, words of prompts.
OPERATIONS = ["join", "filter", "select", "with_columns", "group_by", "agg", "sort", "unique", "head", "tail", "drop_nulls", "fill_null", "rename", "cast"]
ERROR_CLASSES = {
    "column_not_found": ["column", "not found", "columnnotfounderror", "no column", "unknown column"],
    "type_error": ["typeerror", "type mismatch", "cannot cast", "invalid type", "expected type"],
    "join_error": ["join", "left_on", "right_on", "joincolumn", "duplicate column", "ambiguous column"],
    "syntax_error": ["syntaxerror", "invalid syntax", "unexpected token", "parsing error"],
    "schema_error": ["schema", "schemamismatch", "incompatible schema", "column count"],
}
COLUMN_WORDS = ["select", "show", "mostra", "colonna", "column", "field", "campo"]
STOP_WORDS = ["the", "a", "an", "il", "la", "i", "le", "un", "una", "and", "e", "or", "o"]


def word_count(c: Column) -> Column:
    """Words between white space of any kind."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda x: x != ""))


def chunk_quality(title: Column, body: Column, cites: Column, evidence: Column) -> Column:
    """0 to 100: length, number of citations, title, and how much of the evidence is cited."""
    words = word_count(body)
    length = F.when(words.between(100, 450), 30).when(words >= 50, 15).otherwise(0)
    cited = F.least(F.lit(30), 10 * F.size(cites))
    titled = F.when(F.coalesce(title, F.lit("")) != "", 10).otherwise(0)
    covered = F.when(F.size(evidence) > 0, 30.0 * F.size(F.array_intersect(cites, evidence)) / F.size(evidence)).otherwise(0.0)
    return F.round(F.least(F.lit(100.0), length + cited + titled + covered), 2)


def run_quality(success: Column, ms: Column, rows: Column, attempts: Column, wanted: Column, got: Column, reused: Column, validated: Column) -> Column:
    """0 to 100 for a run: success, speed, output, first attempt, wanted columns, reuse, validation. What is null earns nothing."""
    no = F.array().cast("array<string>")
    success, reused, validated = (F.coalesce(c, F.lit(False)) for c in (success, reused, validated))
    wanted, got = F.coalesce(wanted, no), F.coalesce(got, no)
    low = lambda a: F.transform(a, lambda x: F.lower(x))
    speed = F.when(ms < 100, 10).when(ms < 500, 7).when(ms < 1000, 5).otherwise(3)
    hit = F.when(F.size(wanted) > 0, 20.0 * F.size(F.filter(wanted, lambda w: F.array_contains(low(got), F.lower(w)))) / F.size(wanted)).otherwise(0.0)
    total = (
        F.when(success, 30).otherwise(0)
        + speed
        + F.when(rows > 0, 10).otherwise(0)
        + F.when(attempts == 1, 15).otherwise(0)
        + hit
        + F.when(reused & success, 15).otherwise(0)
        + F.when(validated, 30).otherwise(0)
    )
    return F.round(F.least(F.lit(100.0), total.cast("double")), 2)


def operations_in(code: Column) -> Column:
    """The names of the operations that a program's text calls, sorted."""
    named = F.array(*[F.when(F.regexp_like(code, F.lit(rf"\.{n}\s*\(")), F.lit(n)) for n in OPERATIONS])
    return F.array_sort(F.filter(named, lambda x: x.isNotNull()))


#: A join's arguments, as far as the first closing bracket; there need not be one.
JOIN = r"\.join\s*\([^)]*"


def join_info(code: Column) -> Column:
    """left_on, right_on, on, how and coalesce of the first join, as its text up to the first ')' tells; null without a join."""
    inside = F.regexp_extract(code, JOIN, 0)
    arg = lambda n: F.nullif(F.regexp_extract(inside, rf"{n}\s*=\s*[\"']([^\"']+)[\"']", 1), F.lit(""))
    kept = F.nullif(F.regexp_extract(inside, r"coalesce\s*=\s*(True|False)", 1), F.lit(""))
    found = F.struct(arg("left_on").alias("left_on"), arg("right_on").alias("right_on"), arg(r"\bon").alias("on"), F.coalesce(arg("how"), F.lit("inner")).alias("how"), kept.alias("coalesce"))
    return F.when(F.regexp_like(code, F.lit(JOIN)), found)


def risky_join(code: Column) -> Column:
    """Keys of unequal name in a join that drops the right one, whose name is met after the first ``.join`` and before the next."""
    info = join_info(code)
    after = F.get(F.split(code, r"\.join", -1), F.lit(1))
    unequal = info["left_on"] != info["right_on"]
    return F.coalesce(unequal & (F.coalesce(info["coalesce"], F.lit("")) != "False") & F.contains(after, info["right_on"]), F.lit(False))


def prompt_columns(prompt: Column) -> Column:
    """Names in quotes, and words after words such as 'show' or 'column', in their own case, without stop words; sorted."""
    quoted = F.regexp_extract_all(prompt, F.lit(r"[\"']([a-zA-Z_][a-zA-Z0-9_]*)[\"']"), 1)
    after = F.regexp_extract_all(prompt, F.lit(rf"(?iuU)(?:{'|'.join(COLUMN_WORDS)})\s+(\w+)"), 1)
    names = F.array_distinct(F.concat(quoted, after))
    return F.array_sort(F.filter(names, lambda n: ~F.lower(n).isin(STOP_WORDS)))


def error_class(message: Column) -> Column:
    """The first class one of whose signs is in the message, capitals aside."""
    low = F.lower(message)
    out = None
    for name, signs in ERROR_CLASSES.items():
        hit = low.contains(signs[0])
        for w in signs[1:]:
            hit = hit | low.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


def search_text(prompt: Column, columns: Column) -> Column:
    """The prompt and the first ten column names, as they are embedded."""
    return F.when(F.size(columns) > 0, F.concat(prompt, F.lit("\nColumns: "), F.array_join(F.slice(columns, 1, 10), ", "))).otherwise(prompt)
