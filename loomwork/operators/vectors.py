"""Vector search for one query: top-k by dot product or cosine. For a table of queries see vector_joins."""

from __future__ import annotations

import math
import time
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions.semantics import with_row_number

def dot(a: Column, b: Column) -> Column:
    """Sum of products, in double precision; stays in the JVM."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector is zero."""
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale)


def literal(q: Sequence[float]) -> Column:
    """One expression for the whole vector; a column for each component would cost a call to the JVM each."""
    values = [float(x) for x in q]
    if all(math.isfinite(x) for x in values):
        return F.expr(f"array({', '.join(f'{x!r}D' for x in values)})") if values else F.array().cast("array<double>")
    return F.array(*[F.lit(x) for x in values])


def topk(df: DataFrame, q: Sequence[float], k: int, id_col: str = "slug", vector_col: str = "embedding", where: Column | None = None, metric=dot) -> DataFrame:
    """The k best rows with their score; ties go to the smaller id. ``where`` filters before the limit."""
    rows = df if where is None else df.filter(where)
    scored = rows.withColumn("score", metric(F.col(vector_col), literal(q)))
    return scored.filter(F.col("score").isNotNull()).orderBy(F.desc("score"), id_col).limit(k)


def topk_postfiltered(df: DataFrame, q: Sequence[float], k: int, keep: Column, widen: int = 3, **options) -> DataFrame:
    """Top widen*k first, then the filter, then k: may give fewer than k rows, on purpose."""
    id_col = options.get("id_col", "slug")
    return topk(df, q, widen * k, **options).filter(keep).orderBy(F.desc("score"), id_col).limit(k)


def concat_sections(*sections: DataFrame, order: str) -> DataFrame:
    """Vector tables one after the other; ``ord`` counts through all sections, by one range sort and the sizes of its partitions."""
    out = None
    for k, s in enumerate(sections):
        s = s.withColumn("section", F.lit(k))
        out = s if out is None else out.unionByName(s)
    return with_row_number(out, [F.col("section"), F.col(order)], "ord")


#: What a hosted model takes: texts in a call, tokens in a minute; tries when it asks to wait, and seconds to wait first and at most.
CALL_TEXTS, MINUTE_TOKENS, TRIES, FIRST_WAIT, LONGEST_WAIT = 96, 240_000, 4, 30.0, 120.0


def asks_to_wait(error: Exception) -> bool:
    """Whether a model's error is about its rate."""
    low = str(error).lower()
    status = getattr(error, "status", None) or getattr(error, "status_code", None)
    return status == 429 or any(s in low for s in ("429", "rate", "resource_exhausted", "max tokens per minute"))


class ModelEmbedder:
    """A model behind a function from (texts, kind) to vectors, kind being query or passage.

    Calls have CALL_TEXTS texts at most. Each worker keeps to its share of the
    tokens in a minute and waits, longer each time, when the model asks for it.
    """

    def __init__(self, ask: Callable[[list[str], str], list[list[float]]], dims: int, workers: int = 1, texts: int = CALL_TEXTS, tokens: int = MINUTE_TOKENS, sleep=time.sleep, clock=time.monotonic):
        self.ask, self.dims, self.texts, self.tokens = ask, dims, texts, max(1, tokens // max(1, workers))
        self.sleep, self.clock, self.spent = sleep, clock, []

    def _within_budget(self, tokens: int) -> None:
        while True:
            now = self.clock()
            self.spent = [(t, n) for t, n in self.spent if now - t < 60]
            if not self.spent or sum(n for _, n in self.spent) + tokens <= self.tokens:
                self.spent.append((now, tokens))
                return
            self.sleep(max(0.05, 60 - (now - self.spent[0][0])))

    def _call(self, batch: list[str], kind: str) -> list[list[float]]:
        wait = FIRST_WAIT
        for k in range(1, TRIES + 1):
            try:
                return self.ask(batch, kind)
            except Exception as e:
                if not asks_to_wait(e):
                    raise
                if k == TRIES:
                    raise RuntimeError(f"the model asked to wait {TRIES} times: {e}") from e
                self.sleep(min(wait, LONGEST_WAIT))
                wait *= 2

    def embed(self, texts: Iterable[str | None], kind: str = "passage") -> np.ndarray:
        texts, out = [t or "" for t in texts], []
        for a in range(0, len(texts), self.texts):
            batch = texts[a : a + self.texts]
            self._within_budget(sum(max(1, len(t) // 4) for t in batch))
            out += self._call(batch, kind)
        return np.array(out, np.float32).reshape(len(texts), self.dims)

    def query(self, text: str) -> list[float]:
        return self.embed([text], "query")[0].tolist()

    def table(self, df: DataFrame, text_col: str, out: str = "embedding") -> DataFrame:
        """Vectors of a column of passages; the function must be one that can be sent to workers."""
        make = (self.ask, self.dims, 1, self.texts, self.tokens)

        @F.pandas_udf("array<float>")
        def udf(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            own = ModelEmbedder(*make)
            for s in parts:
                yield pd.Series(list(own.embed(s)))

        return df.withColumn(out, udf(F.col(text_col)))


class HashingEmbedder:
    """Offline stand-in for an embedding model: signed hashes of words, unit length. It has no notion of meaning."""

    def __init__(self, dims: int = 64, query_prefix: str = "", passage_prefix: str = ""):
        self.dims, self.query_prefix, self.passage_prefix = dims, query_prefix, passage_prefix

    def embed(self, texts: Iterable[str | None]) -> np.ndarray:
        texts = list(texts)
        out = np.zeros((len(texts), self.dims), np.float32)
        for row, text in enumerate(texts):
            for w in (text or "").lower().split():
                h = zlib.crc32(w.encode("utf-8", "replace"))
                out[row, h % self.dims] += 1.0 if h >> 16 & 1 else -1.0
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, size, out=out, where=size > 0)

    def query(self, text: str) -> list[float]:
        return self.embed([self.query_prefix + text])[0].tolist()

    def table(self, df: DataFrame, text_col: str, out: str = "embedding") -> DataFrame:
        embed, prefix = self.embed, self.passage_prefix

        @F.pandas_udf("array<float>")
        def udf(s: pd.Series) -> pd.Series:
            return pd.Series(list(embed(prefix + (t or "") for t in s)))

        return df.withColumn(out, udf(F.col(text_col)))
