"""Text for and from language models: schemas and evidence in, code out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FENCE = r"```[a-zA-Z]*[ \t]*\n(.*?)```"


def code_in(response: str) -> str:
    """The first fenced block of an answer, else the whole answer."""
    found = re.search(FENCE, response or "", re.S)
    return (found[1] if found else response or "").strip()


def code_column(c: Column) -> Column:
    inner = F.regexp_extract(c, "(?s)" + FENCE, 1)
    return F.trim(F.when(inner != "", inner).otherwise(c), F.lit(" \n\t\r"))


def schema_text(schema: StructType, n_rows: int, nulls: dict[str, int] | None = None, samples: dict[str, list[str]] | None = None) -> str:
    lines = [f"{n_rows} rows"]
    for f in schema:
        line = f"- {f.name}: {f.dataType.simpleString()}"
        if nulls and nulls.get(f.name):
            line += f", {nulls[f.name]} nulls"
        if samples and samples.get(f.name):
            line += ", e.g. " + ", ".join(samples[f.name])
        lines.append(line)
    return "\n".join(lines)


def evidence_text(rows: DataFrame, key: str, order: str, title: str, text: str, longest: int = 1000) -> DataFrame:
    """key, evidence: the texts of a key's rows in order, each cut, under their titles."""
    part = F.concat(F.lit("### "), F.col(title), F.lit("\n"), F.substring(text, 1, longest)).alias("t")
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, part))), lambda x: x["t"]), "\n\n").alias("evidence"))


def repair_prompt(request: str, code: str, problem: str, suggestion: str = "") -> str:
    hint = f"\nHint: {suggestion}" if suggestion else ""
    return f"Request: {request}\n\nThis query failed:\n```sql\n{code}\n```\nProblem: {problem}{hint}\n\nWrite a corrected query."


#: Pages and characters of each that show what a corpus is about.
EXCERPT_PAGES, EXCERPT_CHARS = 30, 300


def excerpt_text(pages: DataFrame, order: str = "page_ord", most: int = EXCERPT_PAGES, longest: int = EXCERPT_CHARS) -> str:
    """The beginnings of a corpus's first pages under their titles: a bounded text."""
    rows = pages.orderBy(order).limit(most).select("slug", F.coalesce("title", F.lit("")).alias("title"), F.trim(F.substring(F.coalesce("body", F.lit("")), 1, longest)).alias("body")).collect()
    return "\n\n".join(f"## [[{r.slug}]]: {r.title.strip()}\n{r.body}" for r in rows)


def examples_text(pairs: list[tuple[str, str]]) -> str:
    """Requests with queries that answered them, to go by."""
    return "\n\n".join(f"Request: {request}\n```sql\n{code}\n```" for request, code in pairs)


def memory_text(rows: list[dict], most: int = 2) -> str:
    """What past runs tell: request, likeness, query; nothing without any."""
    if not rows:
        return ""
    parts = [f"A run that was alike ({r.get('score', 0):.2f}), for \"{r.get('prompt', '')}\":\n```sql\n{r.get('code', '')}\n```" for r in rows[:most]]
    return "These runs went well before; use them if they fit.\n\n" + "\n\n".join(parts)
