"""Queries of vector search, the memory of runs, the link graph and pages."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from loomwork.functions import scores, text
from loomwork.operators import incremental, links, memory, pages as pg, vector_joins, vectors as V
from loomwork.plans.registry import query, t
from loomwork.sources import sinks


def _emb(spark, d):
    return t(spark, d, "embeddings").select(F.col("vec_id").alias("slug"), "embedding", "label")


def _q(spark, d, k=0):
    """One row by its id: a bounded fetch."""
    return _vector(_emb(spark, d), k)


def _vector(e, k=0):
    return list(e.filter(F.col("slug") == k).select("embedding").first()[0])


_DOT = "list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: CAST(e.embedding[i] AS DOUBLE) * CAST(q.embedding[i] AS DOUBLE)))"
_SCORED = f"(SELECT e.vec_id, e.label, {_DOT} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"


def _top(df):
    return df.select(F.col("slug").alias("vec_id"), "label", F.round("score", 4).alias("score"))


@query(f"SELECT vec_id, label, round(s, 4) AS score FROM {_SCORED} ORDER BY s DESC, vec_id LIMIT 5")
def vec_topk(spark, d):
    e = _emb(spark, d)
    return _top(V.topk(e, _vector(e), 5))


@query(f"SELECT vec_id AS id, round(s, 4) AS score FROM {_SCORED} ORDER BY s DESC, vec_id LIMIT 5")
def vec_topk_packed(spark, d):
    """The same search over packed blocks."""
    e = _emb(spark, d)
    packed = vector_joins.packed_blocks(vector_joins.usable(e, "slug", "embedding"), {})
    return vector_joins.search(packed, _vector(e), 5).withColumn("score", F.round("score", 4))


@query(f"SELECT vec_id, label, round(s, 4) AS score FROM {_SCORED} WHERE label IN (1, 2) ORDER BY s DESC, vec_id LIMIT 5")
def vec_topk_prefilter(spark, d):
    return _top(V.topk(_emb(spark, d), _q(spark, d), 5, where=F.col("label").isin(1, 2)))


@query(f"SELECT vec_id, label, round(s, 4) AS score FROM (SELECT * FROM {_SCORED} ORDER BY s DESC, vec_id LIMIT 15) WHERE label IN (1, 2) ORDER BY s DESC, vec_id LIMIT 5")
def vec_topk_postfilter(spark, d):
    return _top(V.topk_postfiltered(_emb(spark, d), _q(spark, d), 5, F.col("label").isin(1, 2)))


@query(f"SELECT vec_id, label, round(s, 4) AS score FROM (SELECT * FROM {_SCORED} ORDER BY s DESC, vec_id LIMIT 3) WHERE label >= 3 ORDER BY s DESC, vec_id LIMIT 1")
def vec_first_kind_match(spark, d):
    return _top(V.topk_postfiltered(_emb(spark, d), _q(spark, d), 1, F.col("label") >= 3))


@query(f"SELECT vec_id, label, round(s, 4) AS score FROM {_SCORED} ORDER BY s DESC, vec_id LIMIT 3")
def vec_topk_all_namespaces(spark, d):
    return _top(V.topk(_emb(spark, d), _q(spark, d), 3))


@query(f"SELECT vec_id, label, round(s / sqrt({_DOT.replace('q.', 'e.')} * qq), 4) AS score FROM (SELECT e.*, {_DOT} AS s, {_DOT.replace('e.embedding[i]', 'q.embedding[i]')} AS qq FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) e ORDER BY s / sqrt({_DOT.replace('q.', 'e.')} * qq) DESC, vec_id LIMIT 5")
def vec_true_cosine(spark, d):
    return _top(V.topk(_emb(spark, d), _q(spark, d), 5, metric=V.cosine))


_PAIRS = "(SELECT q.vec_id AS query_id, e.vec_id AS id, {dot} AS s FROM embeddings e, (SELECT vec_id, embedding FROM embeddings {where}) q WHERE q.vec_id <> e.vec_id)"


@query(
    "SELECT query_id, rank, id, round(s, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM "
    + _PAIRS.format(dot=_DOT, where="WHERE vec_id % 50 = 0")
    + ") WHERE rank <= 3"
)
def vec_topk_batch(spark, d):
    """Queries: every vector whose id is divisible by 50."""
    e = t(spark, d, "embeddings")
    return vector_joins.topk_join(e.filter("vec_id % 50 = 0"), e, 3, "vec_id", "vec_id", exclude_self=True).withColumn("score", F.round("score", 4))


@query(
    "SELECT query_id, id, round(s, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM "
    + _PAIRS.format(dot=_DOT, where="")
    + ") WHERE rank = 1 AND s >= 0.4"
)
def vec_neardup(spark, d):
    return vector_joins.near_duplicates(t(spark, d, "embeddings"), 0.4, "vec_id").withColumn("score", F.round("score", 4))


@query("SELECT vec_id, section, row_number() OVER (ORDER BY section, vec_id) - 1 + 1 AS ord FROM (SELECT vec_id, 0 AS section FROM embeddings WHERE label < 5 UNION ALL SELECT vec_id, 1 FROM embeddings WHERE label >= 5)")
def vec_concat_sections(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", "label")
    return V.concat_sections(e.filter("label < 5"), e.filter("label >= 5"), order="vec_id").select("vec_id", "section", "ord")


@query(f"SELECT vec_id, round(s, 4) AS score FROM (SELECT * FROM {_SCORED} WHERE label < 6 AND vec_id % 10 >= 5 ORDER BY s DESC, vec_id LIMIT 8) WHERE s >= 0.2 ORDER BY s DESC, vec_id LIMIT 4")
def vec_search_memory(spark, d):
    m = t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", (F.col("label") < 6).alias("success"), (F.col("vec_id") % 10 * 10).cast("double").alias("quality_score"), F.lit("df.select('a')").alias("code"))
    return memory.search(m, _q(spark, d), 4, least_score=0.2).select(F.col("id").alias("vec_id"), F.round("score", 4).alias("score"))


# --- a synthetic corpus, made by the same rule on both engines -----------------

CORPUS = """
WITH base AS (
  SELECT 'regions/' || r_name AS slug, r_name AS title, 'Region ' || r_name || '. See [[regions/' || r_name || ']] and [[nowhere]].' AS body, 'page' AS kind, r_regionkey AS ord FROM region
  UNION ALL SELECT 'nations/' || n_name, n_name, 'Nation in [[regions/' || r_name || '|its region]].', 'page', 100 + n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'suppliers/' || CAST(s_suppkey AS VARCHAR), s_name, 'Supplier of [[/nations/' || n_name || ']] and [[ nations/' || n_name || ' ]].', 'chunk', 1000 + s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
)
"""
_EDGES = CORPUS + """, raw AS (SELECT slug AS src, ltrim(trim(unnest(regexp_extract_all(body, '\\[\\[([^\\]\\|]+)(?:\\|[^\\]]+)?\\]\\]', 1))), '/') AS dst FROM base),
edges AS (SELECT DISTINCT src, dst FROM raw WHERE src <> dst AND dst IN (SELECT slug FROM base))
"""


def corpus(spark, d):
    r, n, s = t(spark, d, "region"), t(spark, d, "nation"), t(spark, d, "supplier")
    c = lambda *xs: F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in xs])
    row = lambda slug, title, body, kind, order: [slug.alias("slug"), title.alias("title"), body.alias("body"), F.lit(kind).alias("kind"), order.cast("long").alias("page_ord")]
    rn, nn, sk = F.col("r_name"), F.col("n_name"), F.col("s_suppkey")
    a = r.select(*row(c("regions/", rn), rn, c("Region ", rn, ". See [[regions/", rn, "]] and [[nowhere]]."), "page", F.col("r_regionkey")))
    b = n.join(r, n.n_regionkey == r.r_regionkey).select(*row(c("nations/", nn), nn, c("Nation in [[regions/", rn, "|its region]]."), "page", F.col("n_nationkey") + 100))
    e = s.join(n, s.s_nationkey == n.n_nationkey).select(*row(c("suppliers/", sk.cast("string")), F.col("s_name"), c("Supplier of [[/nations/", nn, "]] and [[ nations/", nn, " ]]."), "chunk", sk + 1000))
    return a.unionByName(b).unionByName(e)


def _e(spark, d):
    return links.edges(corpus(spark, d))


@query(_EDGES + "SELECT src, dst FROM edges")
def wiki_edges(spark, d):
    return _e(spark, d)


@query(_EDGES + "SELECT src AS slug FROM edges WHERE dst = 'nations/NATION_7'")
def backlinks(spark, d):
    return links.backlinks(_e(spark, d), "nations/NATION_7")


@query(_EDGES + "SELECT dst AS slug FROM edges WHERE src = 'nations/NATION_7'")
def forward_links(spark, d):
    return links.forward_links(_e(spark, d), "nations/NATION_7")


@query(
    _EDGES.replace("WITH base", "WITH RECURSIVE base")
    + """, both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
walk(level, slug) AS (SELECT 0, 'regions/EUROPE' UNION SELECT level + 1, dst FROM walk JOIN both_ways ON slug = src WHERE level < 3)
SELECT min(level) AS level, slug FROM walk GROUP BY slug HAVING min(level) > 0"""
)
def neighborhood(spark, d):
    return links.neighborhood(_e(spark, d), "regions/EUROPE", 3)


@query(_EDGES + "SELECT slug FROM base WHERE slug NOT IN (SELECT dst FROM edges)")
def orphans(spark, d):
    return links.orphans(corpus(spark, d), _e(spark, d))


@query(_EDGES + "SELECT dst AS slug, count(*) AS n_links FROM edges GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7")
def most_cited(spark, d):
    return links.most_cited(_e(spark, d), 7)


@query(_EDGES + "SELECT count(*) AS n_edges FROM edges")
def edge_count(spark, d):
    return _e(spark, d).agg(F.count("*").alias("n_edges"))


@query(CORPUS + "SELECT slug, title FROM base WHERE kind <> 'chunk' ORDER BY ord LIMIT 12")
def list_by_kind(spark, d):
    return pg.list_by_kind(corpus(spark, d), "page", 12).select("slug", "title")


@query(CORPUS + "SELECT slug, title, body FROM base WHERE slug = 'nations/NATION_14'")
def read_page(spark, d):
    return pg.read_page(corpus(spark, d), "nations/NATION_14").select("slug", "title", "body")


@query(CORPUS + "SELECT slug, kind, NULL::VARCHAR AS teacher, title AS source_query FROM base WHERE slug = 'suppliers/1'")
def provenance(spark, d):
    p = corpus(spark, d).withColumn("frontmatter", F.create_map(F.lit("kind"), F.col("kind"), F.lit("source_query"), F.col("title")))
    return pg.provenance(p, "suppliers/1").select("slug", "kind", "teacher", "source_query")


@query(CORPUS + "SELECT 'wiki://' || replace(slug, ' ', '%20') AS uri, '[' || kind || '] ' || title AS name FROM base")
def resource_list(spark, d):
    return pg.resources(corpus(spark, d)).select("uri", "name")


# --- lookups over documents -----------------------------------------------------


@query("SELECT d.doc_id, d.lang, h.score FROM documents d JOIN (VALUES (3, 0.9), (1, 0.8), (999999, 0.7)) h(doc_id, score) ON d.doc_id = h.doc_id")
def lookup_hits(spark, d):
    hits = spark.createDataFrame([(3, 0.9), (1, 0.8), (999999, 0.7)], "slug long, score double")
    return pg.lookup(F.broadcast(hits), t(spark, d, "documents").select(F.col("doc_id").alias("slug"), "lang")).select(F.col("slug").alias("doc_id"), "lang", "score")


@query("SELECT 1 AS chunk, list(text ORDER BY pos) AS texts FROM documents JOIN (VALUES (0, 7), (1, 2), (2, 999999), (3, 5)) v(pos, doc_id) USING (doc_id)")
def lookup_ordered_evidence(spark, d):
    wanted = spark.createDataFrame([(1, [7, 2, 999999, 5])], "chunk int, slugs array<long>")
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("slug"), F.col("text").alias("head"))
    return pg.ordered_evidence(wanted, docs, "chunk", "slugs", "head")


@query(
    "WITH c AS (SELECT doc_id AS chunk, generate_subscripts(x, 1) AS pos, unnest(x) AS cite FROM (SELECT doc_id, [doc_id + 3, doc_id, doc_id + 900000000, doc_id + 3] AS x FROM documents)), "
    "k AS (SELECT chunk, list(cite ORDER BY pos) AS cites FROM c WHERE cite IN (SELECT doc_id FROM documents) GROUP BY 1) "
    "SELECT doc_id AS chunk, coalesce(cites, []) AS cites FROM documents LEFT JOIN k ON chunk = doc_id"
)
def cites_in_corpus(spark, d):
    i = F.col("doc_id")
    docs = t(spark, d, "documents")
    chunks = docs.select(i.alias("chunk"), F.array(i + 3, i, i + 900000000, i + 3).alias("cites"))
    return pg.cites_in_corpus(chunks, docs.select(i.alias("slug")), "chunk")


@query("SELECT count(*) AS n FROM documents WHERE regexp_matches(text, '\\S')")
def nonblank_content(spark, d):
    return pg.nonblank(t(spark, d, "documents").select("text"), "text").agg(F.count("*").alias("n"))


@query("SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn, min(doc_id) OVER (PARTITION BY lang) AS f FROM documents) WHERE rn <= 50 // (SELECT count(DISTINCT lang) FROM documents) ORDER BY f, doc_id LIMIT 50")
def sample_stratified(spark, d):
    return pg.stratified_first(t(spark, d, "documents").select("doc_id", "lang"), 50, "lang", "doc_id").select("doc_id", "lang")


@query("SELECT count(*) FILTER (lang <> 'en' AND regexp_matches(text, '\\S')) AS n_pages, count(*) FILTER (lang = 'en') AS n_chunks FROM documents")
def corpus_counts(spark, d):
    return pg.counts(t(spark, d, "documents").select(F.when(F.col("lang") == "en", "chunk").otherwise("page").alias("kind"), F.col("text").alias("content_full")))


@query("SELECT round(coalesce(avg(quality * 100.0), 0), 2) AS mean_quality FROM labels")
def mean_quality(spark, d):
    return pg.mean_quality(t(spark, d, "labels").select((F.col("quality") * 100.0).alias("quality_score")))


# --- text functions -------------------------------------------------------------


@query("SELECT doc_id, sha256(text) AS h FROM documents")
def content_hash(spark, d):
    return t(spark, d, "documents").select("doc_id", text.content_hash("text").alias("h"))


@query("SELECT p_partkey, substr(trim(regexp_replace(lower(trim(p_name || ' / ' || p_brand)), '[^a-zA-Z0-9_-]+', '-', 'g'), '-'), 1, 60) AS slug FROM part")
def slugify(spark, d):
    return t(spark, d, "part").select("p_partkey", text.slugify(F.concat("p_name", F.lit(" / "), "p_brand")).alias("slug"))


@query("SELECT doc_id, greatest(1, length(text) // 4) AS tokens FROM documents")
def token_estimate(spark, d):
    return t(spark, d, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT page_id, CASE WHEN trim(regexp_replace(url, '[^a-zA-Z0-9_./-]+', '-', 'g'), '-/') = '' THEN 'page' ELSE trim(regexp_replace(url, '[^a-zA-Z0-9_./-]+', '-', 'g'), '-/') END AS path FROM pages")
def safe_path(spark, d):
    return t(spark, d, "pages").select("page_id", text.safe_path(F.col("url")).alias("path"))


@query("SELECT page_id, trim(left(trim(regexp_replace(lower(url), '[^a-z0-9-]+', '-', 'g'), '-'), 45), '-') AS name FROM pages")
def index_name(spark, d):
    return t(spark, d, "pages").select("page_id", text.index_name(F.col("url")).alias("name"))


@query("SELECT p_partkey, 'wiki://' || replace(p_name, ' ', '%20') AS uri, p_name AS slug FROM part")
def uri_roundtrip(spark, d):
    uri = text.slug_to_uri(F.col("p_name"))
    return t(spark, d, "part").select("p_partkey", uri.alias("uri"), text.uri_to_slug(uri).alias("slug"))


_WORDS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))"


@query(f"SELECT doc_id, CASE WHEN {_WORDS} BETWEEN 100 AND 450 THEN 30 WHEN {_WORDS} >= 50 THEN 15 ELSE 0 END + 20 + 10 + 15.0 AS score FROM documents")
def chunk_quality(spark, d):
    lit = lambda *xs: F.array(*[F.lit(x) for x in xs])
    return t(spark, d, "documents").select("doc_id", scores.chunk_quality(F.lit("title"), F.col("text"), lit("a", "b"), lit("a", "c")).alias("score"))


# Runs, programs, requests and messages made from tables by one rule on both engines; the scores are then worked out in SQL.
RUNS = """
WITH runs AS (SELECT o_orderkey AS id, o_orderstatus <> 'P' AS success, o_orderkey * 37 % 2500 AS ms, o_orderkey % 3 AS n, 1 + o_custkey % 2 AS attempts,
  CASE WHEN o_orderkey % 5 = 0 THEN [] ELSE ['Region', o_orderstatus, 'n'] END AS wanted, CASE WHEN o_custkey % 3 = 0 THEN ['region'] ELSE ['REGION', 'N', 'o'] END AS got,
  o_custkey % 4 = 0 AS reused, o_orderkey % 7 = 0 AS validated FROM orders)
SELECT id, round(least(100.0, CASE WHEN success THEN 30 ELSE 0 END + CASE WHEN ms < 100 THEN 10 WHEN ms < 500 THEN 7 WHEN ms < 1000 THEN 5 ELSE 3 END + CASE WHEN n > 0 THEN 10 ELSE 0 END
  + CASE WHEN attempts = 1 THEN 15 ELSE 0 END + CASE WHEN len(wanted) > 0 THEN 20.0 * len(list_filter(wanted, lambda w: list_contains(list_transform(got, lambda g: lower(g)), lower(w)))) / len(wanted) ELSE 0 END
  + CASE WHEN reused AND success THEN 15 ELSE 0 END + CASE WHEN validated THEN 30 ELSE 0 END), 2) AS score FROM runs
"""


@query(RUNS)
def run_quality(spark, d):
    k, c, st = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus")
    words = lambda *xs: F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    none = F.array().cast("array<string>")
    wanted, got = F.when(k % 5 == 0, none).otherwise(words("Region", st, "n")), F.when(c % 3 == 0, words("region")).otherwise(words("REGION", "N", "o"))
    return t(spark, d, "orders").select(k.alias("id"), scores.run_quality(st != "P", k * 37 % 2500, k % 3, 1 + c % 2, wanted, got, c % 4 == 0, k % 7 == 0).alias("score"))


_OPS = "['join', 'filter', 'select', 'with_columns', 'group_by', 'agg', 'sort', 'unique', 'head', 'tail', 'drop_nulls', 'fill_null', 'rename', 'cast', 'pivot', 'over']"
_CODE = f"'df.' || ({_OPS})[1 + p_partkey % 16] || ' (x).' || ({_OPS})[1 + p_size % 16] || '(y).collect()'"


@query(f"SELECT p_partkey, list_sort(list_filter(({_OPS})[1:14], lambda o: regexp_matches({_CODE}, '\\.' || o || '\\s*\\('))) AS ops FROM part")
def ops_extract(spark, d):
    ops = F.array(*[F.lit(x) for x in re.findall("[a-z_]+", _OPS)])
    pick = lambda c: F.get(ops, (F.col(c) % 16).cast("int"))
    code = F.concat(F.lit("df."), pick("p_partkey"), F.lit(" (x)."), pick("p_size"), F.lit("(y).collect()"))
    return t(spark, d, "part").select("p_partkey", scores.operations_in(code).alias("ops"))


_RIGHT = "CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'k' || p_size END"


@query(f"SELECT p_partkey, p_brand AS left_on, {_RIGHT} AS right_on, CASE WHEN p_partkey % 3 = 0 THEN 'left' ELSE 'inner' END AS how, p_brand <> {_RIGHT} AND p_partkey % 3 <> 1 AS risky FROM part WHERE p_partkey % 11 <> 0 UNION ALL SELECT p_partkey, NULL, NULL, NULL, false FROM part WHERE p_partkey % 11 = 0")
def join_info(spark, d):
    k = F.col("p_partkey")
    right = F.when(k % 2 == 0, F.col("p_brand")).otherwise(F.concat(F.lit("k"), F.col("p_size").cast("string")))
    more = F.when(k % 3 == 0, ', how="left"').when(k % 3 == 1, ", coalesce=False").otherwise("")
    closed = F.when(k % 5 == 0, "").otherwise(")")  # the first bracket that closes may be another one
    code = F.concat(F.lit("df.join (b, left_on='"), F.col("p_brand"), F.lit("', right_on='"), right, F.lit("'"), more, closed, F.lit(".select(x)"))
    code = F.when(k % 11 == 0, F.lit("df.select(x)")).otherwise(code)
    info = scores.join_info(code)
    return t(spark, d, "part").select("p_partkey", info["left_on"].alias("left_on"), info["right_on"].alias("right_on"), info["how"].alias("how"), scores.risky_join(code).alias("risky"))


@query("SELECT p_partkey, list_sort(list_distinct(list_filter(['c' || p_size, regexp_extract(p_brand, '^\\w+')], lambda x: x <> ''))) AS names FROM part")
def prompt_columns(spark, d):
    request = F.concat(F.lit("SHOW "), F.col("p_brand"), F.lit(" by 'c"), F.col("p_size").cast("string"), F.lit("' and the column the"))
    return t(spark, d, "part").select("p_partkey", scores.prompt_columns(request).alias("names"))


_MESSAGES = ["Column X is gone", "TypeError: bad", "left_on differs", "Invalid Syntax near", "SchemaMismatch in file", "boom", "cannot cast to join", "unexpected token, schema"]


@query("SELECT p_partkey, (['column_not_found', 'type_error', 'join_error', 'syntax_error', 'schema_error', 'unknown', 'type_error', 'syntax_error'])[1 + p_partkey % 8] AS kind FROM part")
def error_class(spark, d):
    said = F.get(F.array(*[F.lit(m) for m in _MESSAGES]), (F.col("p_partkey") % 8).cast("int"))
    return t(spark, d, "part").select("p_partkey", scores.error_class(F.concat(said, F.lit(" "), F.col("p_size").cast("string"))).alias("kind"))


# --- functions that had no query of their own ---------------------------------------


@query("SELECT doc_id, left(text, 400) AS snippet, left(text, 1500) AS fresh, left(CASE WHEN lang = 'fr' THEN '> ' || text ELSE text END, 8000) AS stored FROM documents")
def truncations(spark, d):
    docs = t(spark, d, "documents")
    kept = pg.store_metadata(_as_pages(docs)).select(F.col("slug").alias("doc_id"), F.col("text").alias("stored"))
    x = F.col("text")
    return docs.select("doc_id", text.snippet(x).alias("snippet"), text.fresh_passage(x).alias("fresh")).join(kept, "doc_id")


def _as_pages(docs):
    """Documents as pages; those in French as chunks with a body of their own."""
    chunk = F.col("lang") == "fr"
    return docs.select(
        F.col("doc_id").alias("slug"), F.when(chunk, "chunk").alias("kind"), F.col("source").alias("title"), F.concat(F.lit("> "), "text").alias("body"), F.col("text").alias("content_full"),
        F.array("lang", "source").alias("cites"), F.col("n_chars").cast("double").alias("quality_score"),
    )


@query("SELECT doc_id AS slug, CASE WHEN lang = 'fr' THEN 'chunk' ELSE 'page' END AS kind, source AS title, left(CASE WHEN lang = 'fr' THEN '> ' || text ELSE text END, 8000) AS text, sha256(text) AS content_hash, CASE WHEN lang = 'fr' THEN [lang, source] END AS cites, CASE WHEN lang = 'fr' THEN CAST(n_chars AS DOUBLE) END AS quality_score FROM documents")
def store_metadata(spark, d):
    return pg.store_metadata(_as_pages(t(spark, d, "documents")))


@query("SELECT doc_id AS slug, source AS title, lang AS archetype_id, lang || '-x' AS category, source AS source_query, CAST(n_chars AS DOUBLE) AS quality_score, 2 AS cites_count, [lang, source] AS cites FROM documents")
def chunk_rows(spark, d):
    chunks = _as_pages(t(spark, d, "documents")).join(t(spark, d, "documents").select(F.col("doc_id").alias("slug"), "lang"), "slug")
    asked = chunks.withColumn("archetype_id", F.col("lang")).withColumn("category", F.concat("lang", F.lit("-x"))).withColumn("source_query", F.col("title"))
    return sinks.chunk_rows(asked)


@query("SELECT label AS slug, arg_max(embedding, vec_id) AS embedding FROM embeddings GROUP BY 1")
def last_vectors(spark, d):
    return incremental.last_vectors(t(spark, d, "embeddings").select(F.col("label").alias("slug"), F.col("vec_id").alias("row_ord"), "embedding"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN o_orderstatus || chr(10) || 'Columns: a, ' || o_orderpriority ELSE o_orderstatus END AS text FROM orders")
def search_text(spark, d):
    columns = F.when(F.col("o_custkey") % 2 == 0, F.array(F.lit("a"), F.col("o_orderpriority"))).otherwise(F.array().cast("array<string>"))
    return t(spark, d, "orders").select("o_orderkey", scores.search_text(F.col("o_orderstatus"), columns).alias("text"))


@query("SELECT p_partkey, lower(p_brand) || '--' || substr(trim(regexp_replace(lower(trim(p_name)), '[^a-zA-Z0-9_-]+', '-', 'g'), '-'), 1, 60) AS id FROM part")
def archetype_ids(spark, d):
    return t(spark, d, "part").select("p_partkey", text.archetype_id(F.lower("p_brand"), F.col("p_name")).alias("id"))
