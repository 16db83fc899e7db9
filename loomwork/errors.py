"""Errors that say what kind they are, whether a retry may help, and what to do."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.errors import PySparkException


@dataclass
class Context:
    category: str
    message: str
    details: dict = field(default_factory=dict)
    recoverable: bool = False
    suggestion: str | None = None


class EngineError(Exception):
    """The root of them; ``category`` and ``recoverable`` are those of the class."""

    category, recoverable, hint = "unknown", False, None

    def __init__(self, message: str, suggestion: str | None = None, **details):
        self.context = Context(self.category, message, details, self.recoverable, suggestion or self.hint)
        super().__init__(message)

    @property
    def user_message(self) -> str:
        c = self.context
        return c.message + (f" Suggestion: {c.suggestion}" if c.suggestion else "")

    def to_dict(self) -> dict:
        return asdict(self.context)


class InvalidInput(EngineError):
    category, recoverable, hint = "validation", True, "check the request"


class LoadFailed(EngineError):
    category, recoverable, hint = "data_loading", True, "check that the file can be reached and is what its name says"


class SchemasDiffer(EngineError):
    category, recoverable, hint = "schema_mismatch", True, "give all files columns of the same names and types"


class GenerationFailed(EngineError):
    category, recoverable, hint = "llm_generation", True, "say the request in another way"


class QueryFailed(EngineError):
    category, recoverable, hint = "code_execution", True, "ask for something simpler"


class Forbidden(EngineError):
    category, recoverable, hint = "code_execution", False, "ask for what only reads the given tables"


class TookTooLong(EngineError):
    category, recoverable, hint = "timeout", True, "read less or aggregate earlier"


class OutOfMemory(EngineError):
    category, recoverable, hint = "memory", True, "read less or use more, smaller partitions"


def wrapped(error: Exception, **details) -> EngineError:
    """Any error as one of these, by its type and, for Spark's, its condition."""
    from loomwork.plans.gate import Rejected, TimeLimit
    from loomwork.sources.tabular import SourceError

    if isinstance(error, EngineError):
        return error
    text = str(error).splitlines()[0][:500] if str(error) else type(error).__name__
    low = str(error).lower()
    if isinstance(error, Rejected):
        kind = Forbidden
    elif isinstance(error, (TimeLimit, TimeoutError)):
        kind = TookTooLong
    elif isinstance(error, MemoryError) or "outofmemory" in low or "out of memory" in low:
        kind = OutOfMemory
    elif isinstance(error, (SourceError, FileNotFoundError)) or "PATH_NOT_FOUND" in str(error):
        kind = LoadFailed
    elif isinstance(error, PySparkException):
        condition = error.getCondition() or ""
        kind = SchemasDiffer if condition.startswith(("INCOMPATIBLE", "NUM_COLUMNS_MISMATCH", "CANNOT_MERGE")) else QueryFailed
    else:
        kind = InvalidInput if isinstance(error, ValueError) else EngineError
    return kind(text, **details)
