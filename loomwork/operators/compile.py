"""Compiling a corpus: pages, links, vectors and generated answer chunks; in full or by what changed.

Language and embedding models are given as functions, so that the dataflow can
run and be tested without a network.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions.scores import chunk_quality
from loomwork.functions.text import archetype_id
from loomwork.operators import incremental as I, links, pages as pg
from loomwork.operators.incremental import State
from loomwork.operators.vector_joins import topk_join
from loomwork.operators.vectors import HashingEmbedder
from loomwork.runtime import pin
from loomwork.sources.corpus import build_manifest, read_bundle

# The categories of questions.
CATEGORIES = ("ranking_top_n", "comparative", "predictive", "explanatory", "tactical_recipe")
EVIDENCE = 8
DUPLICATE_AT = 0.92

#: (title, body, cites) from (query, evidence texts by slug).
Generator = Callable[[str, dict[str, str]], tuple[str, str, list[str]]]


@dataclass(frozen=True)
class Thesis:
    """What a corpus is for; its hash names everything that is generated from it."""

    target_audience: str = ""
    primary_use_case: str = ""
    answer_style: str = ""
    key_concepts: tuple[str, ...] = ()
    excluded_topics: tuple[str, ...] = ()
    summary: str = field(default="", compare=False)

    @property
    def hash(self) -> str:
        five = {k: sorted(v) if isinstance(v, tuple) else v for k, v in asdict(self).items() if k != "summary"}
        return hashlib.sha256(json.dumps(five, sort_keys=True).encode()).hexdigest()[:16]


@dataclass
class Usage:
    """Tokens that models were asked for and gave."""

    calls: int = 0
    tokens_in: int = 0
    tokens_out: int = 0

    def add(self, n_in: int, n_out: int) -> None:
        self.calls, self.tokens_in, self.tokens_out = self.calls + 1, self.tokens_in + n_in, self.tokens_out + n_out

    def counted(self, ask: Callable[[str], str]) -> Callable[[str], str]:
        """``ask``, with what goes in and comes out added up here; about four characters are a token."""

        def asked(prompt: str) -> str:
            answer = ask(prompt)
            self.add(max(1, len(prompt) // 4), max(1, len(answer) // 4))
            return answer

        return asked


def generated_usage(chunks: DataFrame) -> Usage:
    """Tokens of a table of generated chunks, summed on the executors: questions and evidence in, titles and texts out."""
    tokens = lambda c: F.greatest(F.lit(1), F.floor(F.length(c) / 4))
    r = chunks.agg(F.count("*").alias("n"), F.sum(tokens(F.col("source_query")) + 250 * F.size("evidence_slugs")).alias("i"), F.sum(tokens(F.col("content_full"))).alias("o")).first()
    return Usage(r["n"], int(r["i"] or 0), int(r["o"] or 0))


def valid_archetypes(rows: Iterable[dict], categories: Iterable[str] = CATEGORIES) -> list[dict]:
    """Those with a known category and a query."""
    known = set(categories)
    return [r for r in rows if isinstance(r, dict) and r.get("category") in known and str(r.get("query") or "").strip()]


def archetype_table(spark, rows: Iterable[dict]) -> DataFrame:
    """id, category, query, ord; the first of equal ids."""
    data = [(r["category"], r["query"].strip(), i) for i, r in enumerate(valid_archetypes(rows))]
    df = spark.createDataFrame(data, "category string, query string, ord long")
    df = df.withColumn("id", archetype_id(F.col("category"), F.col("query")))
    return df.groupBy("id").agg(F.min_by(F.struct("category", "query", "ord"), "ord").alias("r")).select("id", "r.*")


def retrieve(archetypes: DataFrame, page_vectors: DataFrame, embedder: HashingEmbedder, k: int = EVIDENCE) -> DataFrame:
    """id, slug, rank: the nearest pages of every archetype's query, all queries at once."""
    asked = embedder.table(archetypes.select("id", "query"), "query").select(F.col("id").alias("archetype"), F.xxhash64("id").alias("q"), "embedding")
    held = page_vectors.select("slug", F.xxhash64("slug").alias("v"), "embedding")
    found = topk_join(asked, held, k, "q", "v").select(F.col("query_id").alias("q"), F.col("id").alias("v"), "rank")
    return found.join(asked.select("archetype", "q"), "q").join(held.select("slug", "v"), "v").select(F.col("archetype").alias("id"), "slug", "rank")


def generate_chunks(archetypes: DataFrame, evidence: DataFrame, pages: DataFrame, write: Generator, thesis: Thesis) -> DataFrame:
    """One chunk for each archetype with evidence, scored; the generator runs on the executors."""
    texts = evidence.join(pages.select("slug", F.substring("content_full", 1, 1000).alias("t")), "slug")
    grouped = texts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "slug", "t"))).alias("e"))
    rows = archetypes.join(grouped, "id").select("id", "category", "query", F.transform("e", lambda x: x["slug"]).alias("evidence_slugs"), F.transform("e", lambda x: x["t"]).alias("texts"))

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for f in frames:
            made = [write(q, dict(zip(s, t))) for q, s, t in zip(f["query"], f["evidence_slugs"], f["texts"])]
            out = f.drop(columns=["texts"])
            out["title"], out["body"], out["cites"] = [[m[k] for m in made] for k in range(3)]
            yield out

    made = rows.mapInPandas(run, "id string, category string, query string, evidence_slugs array<string>, title string, body string, cites array<string>")
    kept = pg.cites_in_corpus(made.select("id", "cites"), pages, "id")
    made = made.drop("cites").join(kept, "id")
    slug = F.concat(F.lit(f"chunks/{thesis.hash}/"), F.col("id"))
    content = F.concat("title", F.lit("\n\n"), "body")
    return made.select(
        slug.alias("slug"), F.substring("title", 1, 200).alias("title"), "body", content.alias("content_full"), F.lit("chunk").alias("kind"), F.col("id").alias("archetype_id"), "category",
        F.lit(thesis.hash).alias("thesis_hash"), F.col("query").alias("source_query"), "cites", "evidence_slugs", chunk_quality(F.col("title"), F.col("body"), F.col("cites"), F.col("evidence_slugs")).alias("quality_score"),
    )


@dataclass
class Compiled:
    pages: DataFrame
    chunks: DataFrame
    edges: DataFrame
    vectors: DataFrame
    archetypes: DataFrame
    state: dict[str, DataFrame]
    mode: str
    reason: str

    def manifest(self, model: str, dims: int, thesis: Thesis) -> dict:
        c = pg.counts(self.pages.select("kind", "content_full")).first()
        return build_manifest(c["n_pages"], self.chunks.count(), self.edges.count(), model, dims, {"hash": thesis.hash, "summary": thesis.summary})


def compile_full(pages: DataFrame, archetype_rows: Iterable[dict], write: Generator, embedder: HashingEmbedder, thesis: Thesis) -> Compiled:
    pages = pin(pg.nonblank(links.newest_pages(pages)))
    archetypes = pin(archetype_table(pages.sparkSession, archetype_rows))
    # models are costly: what they give is computed once
    vectors = pin(embedder.table(pages.select("slug", "content_full"), "content_full").select("slug", "embedding"))
    chunks = pin(generate_chunks(archetypes, pin(retrieve(archetypes, vectors, embedder)), pages, write, thesis))
    both = vectors.unionByName(embedder.table(chunks.select("slug", "content_full"), "content_full").select("slug", "embedding"))
    return Compiled(pages, chunks, links.edges(pages, "frontmatter" in pages.columns), both, archetypes, I.build_state(pages, chunks), "full", "asked for")


def prior_of_bundle(spark: SparkSession, content: bytes) -> tuple[Compiled, State] | None:
    """What a bundle says of the run that made it; None if it has no state, which asks for a full run."""
    manifest, rows, vectors, raw = read_bundle(spark, content)
    if raw is None:
        return None
    state = I.State.from_json(raw)
    tables = state.tables(spark)
    pages, written = rows.filter("kind <> 'chunk'"), rows.filter("kind = 'chunk'")
    part = F.element_at(F.split("slug", "/"), -1)
    known = tables["chunks"].select(F.col("archetype_id").alias("_id"), "evidence_slugs", "source_query", "quality_score")
    of = tables["archetypes"].select(F.col("id").alias("_aid"), "category")
    cites = F.coalesce(F.from_json(F.col("frontmatter")["cites"], "array<string>"), F.array().cast("array<string>"))
    chunks = written.withColumn("archetype_id", F.coalesce(F.col("frontmatter")["archetype_id"], part)).join(known, F.col("archetype_id") == F.col("_id")).join(of, F.col("archetype_id") == F.col("_aid"), "left")
    chunks = chunks.select("slug", "title", "body", "content_full", "kind", "archetype_id", "category", F.lit(state.thesis_hash).alias("thesis_hash"), "source_query", cites.alias("cites"), "evidence_slugs", "quality_score")
    had = Compiled(pages, chunks, links.edges(pages, True), vectors.select("slug", "embedding"), tables["archetypes"], {k: tables[k] for k in ("pages", "chunks")}, "prior", str(manifest.get("compiler", "")))
    return had, state


def compile_changes(prior: Compiled, pages: DataFrame, write: Generator, embedder: HashingEmbedder, thesis: Thesis, prior_model: str | None, model: str) -> Compiled:
    """Embeds what is new, regenerates what is stale, carries the rest over; or compiles in full where that is due."""
    pages = pin(pg.nonblank(links.newest_pages(pages)))
    diff = pin(I.diff_pages(prior.state["pages"], pages.select("slug", F.sha2("content_full", 256).alias("hash"))))
    decision = I.decide(prior_model, model, float(I.changed_fraction(diff).first()[0]))
    if decision.mode == "full":
        full = compile_full(pages.withColumn("page_ord", F.lit(0)) if "page_ord" not in pages.columns else pages, [r.asDict() for r in prior.archetypes.collect()], write, embedder, thesis)
        full.reason = decision.reason
        return full
    wanted = I.pages_needing_embed(pages, diff, prior.vectors)
    fresh = embedder.table(pages.join(wanted, "slug", "left_semi").select("slug", "content_full"), "content_full").select("slug", "embedding")
    order = pages.select("slug", F.xxhash64("slug").alias("ord"))
    vectors = pin(I.stack_vectors(order, fresh, prior.vectors).select("slug", "embedding"))
    stale = I.stale_by_overlap(prior.chunks, I.touched(diff), key="archetype_id")
    moved = prior.chunks.select("archetype_id").subtract(stale)
    now = retrieve(prior.archetypes.join(moved.withColumnRenamed("archetype_id", "id"), "id", "left_semi"), vectors, embedder)
    drifted = I.stale_by_drift(prior.chunks, now.select(F.col("id").alias("archetype_id"), "slug"), key="archetype_id")
    stale = pin(stale.unionByName(drifted).distinct())
    actions = I.split_stale(prior.chunks.join(stale, "archetype_id", "left_semi"), diff.filter("status = 'removed'"), key="archetype_id")
    again = prior.archetypes.join(actions.filter("action = 'regenerate'").select(F.col("archetype_id").alias("id")), "id", "left_semi")
    made = pin(generate_chunks(again, pin(retrieve(again, vectors, embedder)), pages, write, thesis))
    kept = I.carry_over(prior.chunks, stale, key="archetype_id")
    chunks = kept.unionByName(made)
    chunk_vectors = I.stack_vectors(chunks.select("slug", F.xxhash64("slug").alias("ord")), embedder.table(made.select("slug", "content_full"), "content_full").select("slug", "embedding"), prior.vectors.join(kept, "slug", "left_semi"))
    return Compiled(pages, chunks, links.edges(pages, "frontmatter" in pages.columns), vectors.unionByName(chunk_vectors.select("slug", "embedding")), prior.archetypes, I.build_state(pages, chunks), "incremental", decision.reason)
