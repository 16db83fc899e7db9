"""Queries and contracts from language models. Models are functions that the caller gives; nothing here connects."""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

from loomwork.errors import GenerationFailed
from loomwork.functions.prompts import code_in, repair_prompt
from loomwork.plans.gate import FOREIGN, Attempt, Rejected, check_sql

#: From (instruction, request) to an answer.
Model = Callable[[str, str], str]
INSTRUCTION = "You write one query in Spark SQL. Read only the tables that are named. Answer with the query alone, in a code block."
TRIES = 3


@dataclass
class Generated:
    """A query that passed the checks of form, and what it took."""

    code: str
    model: str
    tokens: int = 0
    milliseconds: int = 0
    attempts: int = 0

    def to_dict(self) -> dict:
        return asdict(self)


def check_structure(spark: SparkSession | None, code: str) -> None:
    """Whether an answer can be a query at all: something, no turns of other dialects, and (with a session) a statement that parses and reads."""
    if not code.strip():
        raise Rejected("no query was given")
    for pattern, wrong, right in FOREIGN:
        if re.search(pattern, code, re.I):
            raise Rejected(f"Spark SQL has no {wrong}; use {right}")
    if spark is not None:
        check_sql(spark, code)


@dataclass
class Service:
    """A model that is asked again with what was wrong, and another one that is asked once if it keeps failing."""

    primary: Model
    fallback: Model | None = None
    names: tuple[str, str] = ("primary", "fallback")
    tries: int = TRIES
    spark: SparkSession | None = None
    failures: list[str] = field(default_factory=list)

    def _ask(self, model: Model, name: str, prompt: str, done: Generated) -> str:
        done.model, done.attempts = name, done.attempts + 1
        answer = model(INSTRUCTION, prompt)
        done.tokens += max(1, (len(prompt) + len(answer or "")) // 4)
        return code_in(answer)

    def generate(self, request: str, schema: str = "", context: str = "", before: Attempt | None = None) -> Generated:
        """A query for the request; ``before``: an attempt that ran and failed, to be mended."""
        began, done = time.monotonic(), Generated("", self.names[0])
        first = "\n\n".join(x for x in (schema and f"Tables:\n{schema}", context, f"Request: {request}") if x)
        prompt, code = first, ""
        if before is not None:
            prompt = f"{first}\n\n{mend(request, before)}"
        turns = [(self.primary, self.names[0])] * self.tries + ([(self.fallback, self.names[1])] if self.fallback else [])
        self.failures = []
        for k, (model, name) in enumerate(turns):
            if k == self.tries:
                prompt = first  # the other model starts afresh
            try:
                code = self._ask(model, name, prompt, done)
                check_structure(self.spark, code)
            except Exception as e:
                self.failures.append(f"{name}: {e}")
                prompt = f"{first}\n\n{repair_prompt(request, code, str(e))}"
                continue
            done.code, done.milliseconds = code, int((time.monotonic() - began) * 1000)
            return done
        raise GenerationFailed(f"no query after {done.attempts} attempts: {self.failures[-1] if self.failures else 'no model'}", model=done.model, request=request[:200], attempts=done.attempts)

    def for_retries(self, request: str, schema: str = "", context: str = "") -> Callable[[list[Attempt]], str]:
        """What run_with_retries() asks: the last attempt, if any, is to be mended."""
        return lambda attempts: self.generate(request, schema, context, attempts[-1] if attempts else None).code


def mend(request: str, attempt: Attempt) -> str:
    """What to tell a model of an attempt that failed."""
    if attempt.diagnosis:
        return repair_prompt(request, attempt.text, attempt.diagnosis.message, attempt.diagnosis.suggestion)
    return repair_prompt(request, attempt.text, "; ".join(attempt.verdict.failures) if attempt.verdict else "no result")
