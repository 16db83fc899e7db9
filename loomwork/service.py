"""The tool calls of a knowledge server, as functions from arguments to JSON payloads. Transport is the caller's."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions.text import parse_uri
from loomwork.operators import links, pages as pg
from loomwork.operators.vectors import HashingEmbedder, topk

SNIPPET = 400
# Names of tools and of prompts with their arguments.
TOOLS = {
    "query_wiki": "query",
    "query_wiki_answer": "answer",
    "query_wiki_pages": "query_pages",
    "read_wiki_page": "read",
    "list_wiki_pages": "list_pages",
    "get_thesis": "get_thesis",
    "get_provenance": "provenance",
    "get_wiki_backlinks": "backlinks",
    "get_wiki_graph": "neighborhood",
}
PROMPTS = {
    "summarize_wiki": ((), "Summarize this wiki. Start from `get_thesis`, look over `list_wiki_pages` (kind=\"chunk\" lists prepared answers), then say in five points what it is for, for whom, what its main ideas are, what it leaves out, and which answers stand out."),
    "ask_about": (("question",), "Question: {question}\n\nAnswer it from this wiki alone. See `get_thesis` once for the tone. Take what `query_wiki_answer` has, if anything; otherwise gather pages with `query_wiki_pages`. Name two or more sources as [[slug]]."),
    "compare_topics": (("topic_a", "topic_b"), "Compare {topic_a} with {topic_b} as this wiki has them. Find three pages on each with `query_wiki_pages`, or open one by its slug with `read_wiki_page`. Say what they share, where they differ and when to choose which, with sources as [[slug]]."),
}


def _ok(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, default=str)


def _error(message: str) -> str:
    return json.dumps({"error": message})


@dataclass
class KnowledgeBase:
    pages: DataFrame
    vectors: DataFrame
    edges: DataFrame
    manifest: dict
    embedder: HashingEmbedder
    thesis: dict | None = None

    def call(self, tool: str, **args) -> str:
        """A tool by its name."""
        if tool not in TOOLS:
            return _error(f"no tool {tool}")
        return getattr(self, TOOLS[tool])(**args)

    def get_thesis(self) -> str:
        return _ok(self.thesis) if self.thesis else _error("this corpus has no thesis")

    def query_pages(self, text: str, k: int = 5) -> str:
        """Nearest pages, without prepared answers."""
        return self.query(text, k, "page")

    def query(self, text: str, k: int = 5, kind: str | None = None) -> str:
        """Nearest pages. With a kind, the nearest 3k are looked at and the rest is left out: there may be fewer than k."""
        if not (text or "").strip():
            return _error("the query is empty")
        hits = topk(self.vectors, self.embedder.query(text), 3 * k if kind else k).select("slug", "score")
        rows = pg.lookup(F.broadcast(hits), self.pages)
        if kind:
            rows = rows.filter(F.col("kind") == kind) if kind == "chunk" else rows.filter(F.col("kind") != "chunk")
        out = []
        for r in rows.orderBy(F.desc("score"), "slug").limit(k).collect():
            one = {"slug": r["slug"], "title": r["title"], "kind": r["kind"], "score": round(r["score"], 4)}
            chunk = r["kind"] == "chunk"
            out.append(one | ({"answer": r["body"], "cites": json.loads(r["frontmatter"].get("cites", "[]"))} if chunk else {"snippet": (r["body"] or "")[:SNIPPET]}))
        return _ok({"query": text, "results": out})

    def answer(self, text: str) -> str:
        return self.query(text, 1, "chunk")

    def read(self, slug: str) -> str:
        row = pg.read_page(self.pages, slug).first()
        return _error(f"no page {slug}") if row is None else _ok({"slug": row["slug"], "title": row["title"], "kind": row["kind"], "body": row["body"], "frontmatter": row["frontmatter"]})

    def list_pages(self, kind: str | None = None, limit: int = 50) -> str:
        rows = pg.list_by_kind(self.pages, kind, limit).select("slug", "title", "kind").collect()
        return _ok({"total": len(rows), "pages": [r.asDict() for r in rows]})

    def provenance(self, slug: str) -> str:
        row = pg.provenance(self.pages, slug).first()
        return _error(f"no page {slug}") if row is None else _ok(row.asDict())

    def backlinks(self, slug: str) -> str:
        return _ok({"slug": slug, "backlinks": sorted(r[0] for r in links.backlinks(self.edges, slug).collect())})

    def forward_links(self, slug: str) -> str:
        return _ok({"slug": slug, "forward_links": sorted(r[0] for r in links.forward_links(self.edges, slug).collect())})

    def neighborhood(self, slug: str, depth: int = 1) -> str:
        levels: dict[str, list[str]] = {}
        for r in links.neighborhood(self.edges, slug, depth).collect():
            levels.setdefault(str(r["level"]), []).append(r["slug"])
        return _ok({"slug": slug, "levels": {k: sorted(v) for k, v in sorted(levels.items())}})

    def resources(self) -> DataFrame:
        return pg.resources(self.pages)

    def read_resource(self, uri: str) -> str:
        slug = parse_uri(uri)
        if slug is None:
            return _error("not a resource of this server")
        if slug == "manifest":
            return _ok(self.manifest)
        if slug == "thesis":
            return self.get_thesis()
        row = pg.read_page(self.pages, slug).first()
        return _error(f"no page {slug}") if row is None else f"# {row['title']}\n\n{row['body']}"


def prompt(name: str, **args: str) -> str:
    """The text of a prompt; all of its arguments must say something."""
    if name not in PROMPTS:
        raise ValueError(f"unknown prompt: {name}")
    needs, text = PROMPTS[name]
    given = {n: str(args.get(n) or "").strip() for n in needs}
    if missing := [n for n, v in given.items() if not v]:
        raise ValueError(f"{name} needs {', '.join(missing)}")
    return text.format(**given)
