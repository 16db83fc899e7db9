"""Queries of incremental maintenance, the store, contracts, and round trips through files."""

from __future__ import annotations

import io
import uuid
import zipfile

from pyspark.sql import functions as F

from loomwork.operators import contracts as C, incremental as I, snapshots, store as St, vector_joins
from loomwork.plans import gate
from loomwork.plans.registry import query, t
from loomwork.plans.search import CORPUS, corpus
from loomwork.runtime import shared_dir
from loomwork.sources import sinks, tabular
from loomwork.sources import corpus as Co

# Two snapshots of documents: the prior one lacks every 7th, the new one every 11th and has every 10th edited.
SNAPSHOTS = """
WITH prior AS (SELECT doc_id AS slug, sha256(text) AS hash FROM documents WHERE doc_id % 7 <> 0),
     fresh AS (SELECT doc_id AS slug, sha256(CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 11 <> 0),
     diff AS (SELECT coalesce(p.slug, f.slug) AS slug, CASE WHEN p.slug IS NULL THEN 'added' WHEN f.slug IS NULL THEN 'removed' WHEN p.hash = f.hash THEN 'unchanged' ELSE 'changed' END AS status FROM prior p FULL JOIN fresh f ON p.slug = f.slug)
"""


def _snapshots(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("slug"), "text")
    prior = docs.filter("slug % 7 <> 0").select("slug", F.sha2("text", 256).alias("hash"))
    edited = F.when(F.col("slug") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    fresh = docs.filter("slug % 11 <> 0").select("slug", F.sha2(edited, 256).alias("hash"))
    return prior, fresh


def _diff(spark, d):
    return I.diff_pages(*_snapshots(spark, d))


@query(SNAPSHOTS + "SELECT * FROM diff")
def diff_pages(spark, d):
    return _diff(spark, d)


@query(SNAPSHOTS + "SELECT round(count(*) FILTER (status <> 'unchanged') / count(*) FILTER (status <> 'added'), 6) AS fraction FROM diff")
def diff_fraction(spark, d):
    """By summaries: counts come from the roots, pages from differing leaves."""
    prior, fresh = _written(spark, d)
    return spark.createDataFrame([(round(snapshots.changed_fraction(prior, fresh), 6),)], "fraction double")


def _written(spark, d, bits=snapshots.FAN_BITS):
    return [snapshots.write(x, f"{shared_dir(spark)}/snapshot-{uuid.uuid4().hex}", bits) for x in _snapshots(spark, d)]


@query(SNAPSHOTS + "SELECT * FROM diff")
def diff_snapshots(spark, d):
    return snapshots.diff(*_written(spark, d))


@query(SNAPSHOTS + "SELECT * FROM diff WHERE status <> 'unchanged'")
def diff_changes(spark, d):
    return snapshots.changes(*_written(spark, d, 2 * snapshots.FAN_BITS))


@query(SNAPSHOTS + "SELECT slug FROM diff WHERE status IN ('changed', 'removed')")
def diff_touched(spark, d):
    return I.touched(_diff(spark, d))


@query(SNAPSHOTS + "SELECT doc_id AS slug FROM documents LEFT JOIN diff ON doc_id = slug WHERE status IN ('added', 'changed') OR doc_id % 3 <> 0")
def pages_needing_embed(spark, d):
    docs = t(spark, d, "documents").select(F.col("doc_id").alias("slug"), F.col("text").alias("content_full"))
    return I.pages_needing_embed(docs, _diff(spark, d), docs.filter("slug % 3 = 0").select("slug"))


CHUNKS = SNAPSHOTS + ", chunks AS (SELECT doc_id AS chunk_id, [doc_id, doc_id + 1, doc_id + 5] AS evidence FROM documents)"


def _chunks(spark, d):
    i = F.col("doc_id")
    return t(spark, d, "documents").select(i.alias("chunk_id"), F.array(i, i + 1, i + 5).alias("evidence_slugs"))


@query(CHUNKS + "SELECT chunk_id FROM chunks WHERE len(list_intersect(evidence, (SELECT list(slug) FROM diff WHERE status IN ('changed', 'removed')))) > 0")
def stale_overlap(spark, d):
    return I.stale_by_overlap(_chunks(spark, d), I.touched(_diff(spark, d)))


@query(CHUNKS + "SELECT chunk_id, CASE WHEN status = 'removed' THEN 'drop' ELSE 'regenerate' END AS action FROM chunks LEFT JOIN diff ON chunk_id = slug")
def stale_split(spark, d):
    one = _chunks(spark, d).select("chunk_id", F.array("chunk_id").alias("evidence_slugs"))
    return I.split_stale(one, _diff(spark, d).filter("status = 'removed'"))


_NEAR = """SELECT query_id, list_sort(list(id)) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM (
SELECT q.vec_id AS query_id, e.vec_id AS id, list_sum(list_transform(range(1, 65), lambda i: CAST(e.embedding[i] AS DOUBLE) * CAST(q.embedding[i] AS DOUBLE))) AS s
FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q WHERE {where})) WHERE rank <= 8 GROUP BY 1"""


@query(f"SELECT a.query_id AS chunk_id FROM ({_NEAR.format(where='e.vec_id % 5 <> 0')}) a JOIN ({_NEAR.format(where='true')}) b ON a.query_id = b.query_id WHERE a.ids <> b.ids")
def stale_drift(spark, d):
    e = t(spark, d, "embeddings")
    q = e.filter("vec_id % 50 = 0")
    old = vector_joins.topk_join(q, e.filter("vec_id % 5 <> 0"), 8, "vec_id", "vec_id").groupBy(F.col("query_id").alias("chunk_id")).agg(F.collect_list("id").alias("evidence_slugs"))
    now = vector_joins.topk_join(q, e, 8, "vec_id", "vec_id").select(F.col("query_id").alias("chunk_id"), F.col("id").alias("slug"))
    return I.stale_by_drift(old, now)


@query(SNAPSHOTS + "SELECT coalesce(p.slug, f.slug) AS slug, CASE WHEN f.slug IS NULL THEN 'only_prior' WHEN p.slug IS NULL THEN 'only_new' ELSE 'both' END AS part FROM prior p FULL JOIN fresh f ON p.slug = f.slug")
def slug_set_ops(spark, d):
    return I.slug_sets(*_snapshots(spark, d))


@query(SNAPSHOTS + "SELECT f.slug FROM fresh f WHERE f.slug % 3 = 0 AND f.slug IN (SELECT slug FROM diff WHERE status IN ('added', 'changed'))")
def upsert_candidates(spark, d):
    _, fresh = _snapshots(spark, d)
    return St.upsert_candidates(fresh.filter("slug % 3 = 0"), fresh.select("slug", F.lit("m").alias("meta")), _diff(spark, d).filter("status in ('added', 'changed')")).select("slug")


@query(SNAPSHOTS + "SELECT slug FROM fresh WHERE slug IN (SELECT slug FROM prior)")
def keep_aligned(spark, d):
    prior, fresh = _snapshots(spark, d)
    return I.keep_aligned(fresh.select("slug"), prior)


@query(CHUNKS + ", s AS (SELECT CASE WHEN status = 'removed' THEN 'drop' ELSE 'regenerate' END AS a FROM chunks LEFT JOIN diff ON chunk_id = slug) SELECT count(*) FILTER (status = 'added') AS pages_added, count(*) FILTER (status = 'changed') AS pages_changed, count(*) FILTER (status = 'unchanged') AS pages_unchanged, count(*) FILTER (status = 'removed') AS pages_removed, (SELECT count(*) FROM s) AS chunks_stale, (SELECT count(*) FROM s WHERE a = 'drop') AS chunks_dropped, (SELECT count(*) FROM s WHERE a = 'regenerate') AS chunks_regenerated, count(*) FILTER (status IN ('added', 'changed')) AS pages_embedded, 0 AS chunks_carried, count(*) FILTER (status = 'added') AS chunks_new, round(count(*) FILTER (status <> 'unchanged') / count(*) FILTER (status <> 'added'), 4) AS changed_fraction, true AS thesis_reused FROM diff")
def compile_report(spark, d):
    diff, chunks = _diff(spark, d), _chunks(spark, d)
    stale = stale_split(spark, d)
    return I.report(diff, stale, diff.filter("status in ('added', 'changed')"), I.carry_over(chunks, stale), diff.filter("status = 'added'"))


@query("SELECT vec_id AS slug, vec_id AS ord, CASE WHEN vec_id % 3 = 0 THEN 'fresh' ELSE 'prior' END AS source FROM embeddings WHERE vec_id % 3 = 0 OR vec_id % 2 = 0")
def carry_vectors(spark, d):
    e = t(spark, d, "embeddings").select(F.col("vec_id").alias("slug"), "embedding")
    return I.stack_vectors(e.select("slug", F.col("slug").alias("ord")), e.filter("slug % 3 = 0"), e.filter("slug % 2 = 0")).select("slug", "ord", "source")


@query("SELECT * FROM (SELECT n_nationkey AS id, 'prior' AS src FROM nation WHERE n_nationkey < 15 UNION ALL SELECT n_nationkey, 'new' FROM nation WHERE n_nationkey >= 15)")
def archetype_union(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").alias("ord"))
    return I.archetype_union(n.filter("id < 15").withColumn("src", F.lit("prior")), n.filter("id >= 10").withColumn("src", F.lit("new"))).select("id", "src")


# --- store ----------------------------------------------------------------------


def _store(spark, d):
    i = F.col("doc_id")
    return t(spark, d, "labels").select(i.alias("id"), F.when(i % 13 != 0, (i * 37 % 101).cast("double")).alias("quality_score"), (F.col("toxic") == 0).alias("validator_passed"), (i % 4).alias("reuse_count"), F.when(i % 5 == 0, "failure").otherwise("success").alias("namespace"))


_STORE = "WITH store AS (SELECT doc_id AS id, CASE WHEN doc_id % 13 <> 0 THEN CAST(doc_id * 37 % 101 AS DOUBLE) END AS quality_score, toxic = 0 AS validator_passed, doc_id % 4 AS reuse_count, CASE WHEN doc_id % 5 = 0 THEN 'failure' ELSE 'success' END AS namespace FROM labels) "


@query(_STORE + "SELECT id, 'old' AS src FROM store WHERE id % 2 = 0 AND id % 3 <> 0 AND id % 7 <> 0 UNION ALL SELECT id, 'new' FROM store WHERE id % 3 = 0 AND id % 7 <> 0")
def store_sync_delta(spark, d):
    s = _store(spark, d).select("id")
    old, new = s.filter("id % 2 = 0").withColumn("src", F.lit("old")), s.filter("id % 3 = 0").withColumn("src", F.lit("new"))
    return St.sync_delta(old, new, s.filter("id % 7 = 0"))


@query(_STORE + "SELECT id FROM store WHERE id % 3 = 0")
def store_reset(spark, d):
    s = _store(spark, d).select("id")
    return St.sync_delta(s.filter("id % 2 = 0"), s.filter("id % 3 = 0"), s, reset=True)


@query(_STORE + "SELECT id FROM store WHERE NOT (coalesce(quality_score, -1) >= 80 AND validator_passed)")
def store_purge(spark, d):
    return St.purge(_store(spark, d), 80.0, True, dry_run=False).select("id")


@query(_STORE + "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY coalesce(quality_score, 0) + 6 * reuse_count, id) AS rn FROM store) WHERE rn > (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM store)")
def store_capacity_trim(spark, d):
    return St.trim(_store(spark, d), clean_at=100).select("id")


@query(_STORE + "SELECT CASE WHEN quality_score IS NULL THEN 'unset' WHEN quality_score >= 90 THEN '90-100' WHEN quality_score >= 75 THEN '75-89' WHEN quality_score >= 50 THEN '50-74' WHEN quality_score >= 25 THEN '25-49' ELSE '0-24' END AS bucket, count(*) AS n FROM store GROUP BY 1")
def quality_histogram(spark, d):
    return St.quality_histogram(_store(spark, d))


@query(_STORE + ", r AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY quality_score NULLS LAST) - 1 AS rn, count(quality_score) OVER (PARTITION BY namespace) // 2 AS mid FROM store) SELECT namespace, count(*) AS total, count(quality_score) AS scored, count(*) FILTER (quality_score >= 99.5) AS near_perfect, round(avg(CAST(validator_passed AS DOUBLE)), 4) AS validated, max(CASE WHEN rn = mid THEN quality_score END) AS median FROM r GROUP BY 1")
def store_audit(spark, d):
    return St.audit(_store(spark, d))


# --- contracts ------------------------------------------------------------------


def _orders(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT")).alias("o_orderpriority"))


def _told(spark, df, contract, order_by=None):
    return spark.createDataFrame([(f.split(":")[0],) for f in C.failures(df, contract, order_by)], "rule string")


@query("SELECT 'rows_range' AS rule FROM (SELECT count(*) AS n FROM orders) WHERE n > 100")
def contract_rows(spark, d):
    return _told(spark, _orders(spark, d), C.Contract(rows=(1, 100)))


@query("SELECT 'non_null' AS rule WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderpriority = '1-URGENT')")
def contract_nulls(spark, d):
    return _told(spark, _orders(spark, d), C.Contract(non_null=("O_ORDERPRIORITY", "o_orderkey", "absent")))


@query("SELECT 'value_max[o_totalprice]' AS rule WHERE (SELECT max(o_totalprice) FROM orders) > 1000 UNION ALL SELECT 'value_allowed[o_orderstatus]' WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderstatus NOT IN ('O', 'F'))")
def contract_values(spark, d):
    rules = {"o_totalprice": C.ValueRule(min=0, max=1000), "o_orderstatus": C.ValueRule(allowed=("O", "F")), "o_orderkey": C.ValueRule(unique=True)}
    return _told(spark, _orders(spark, d), C.Contract(values=rules))


@query("SELECT 'monotonicity[o_totalprice]' AS rule WHERE EXISTS (SELECT 1 FROM (SELECT o_totalprice < lag(o_totalprice) OVER (ORDER BY o_orderkey) AS back FROM orders) WHERE back)")
def contract_monotone(spark, d):
    return _told(spark, _orders(spark, d), C.Contract(order={"o_orderkey": "asc", "o_totalprice": "asc"}), "o_orderkey")


@query("SELECT f = 0 AS passed, round(100.0 * (3 - f) / 3, 2) AS score FROM (SELECT CAST((SELECT count(*) > 10 FROM orders) AS INT) + CAST(EXISTS (SELECT 1 FROM orders WHERE o_orderpriority = '1-URGENT') AS INT) AS f)")
def contract_score(spark, d):
    v = C.verify(_orders(spark, d), C.Contract(rows=(1, 10), required=("o_orderkey",), non_null=("o_orderpriority",)))
    return spark.createDataFrame([(v.passed, v.score)], "passed boolean, score double")


@query("SELECT c AS name FROM (SELECT unnest(['gone', 'o_orderkey', 'o_orderpriority', 'o_totalprice']) AS c, unnest([0, count(o_orderkey), count(nullif(o_orderpriority, '1-URGENT')), count(o_totalprice)]) AS n, count(*) AS whole FROM orders) WHERE n = 0 AND whole > 0")
def all_null_cols(spark, d):
    return C.all_null_columns(_orders(spark, d).withColumn("gone", F.lit(None).cast("string")))


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def gated_sql(spark, d):
    tables = {"customer": t(spark, d, "customer"), "nation": t(spark, d, "nation")}
    return gate.run_sql(spark, tables, "SELECT n_name, count(*) AS n FROM df_customer JOIN df_nation ON c_nationkey = n_nationkey GROUP BY n_name")


# --- through files ----------------------------------------------------------------


def _to(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_name || chr(10) || 'b \"q\", c ' AS c_name, c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_mktsegment END AS seg FROM customer")
def csv_roundtrip(spark, d):
    """With values that hold line ends, quotes, separators and blanks at their ends."""
    hard = F.concat("c_name", F.lit('\nb "q", c '))
    df = t(spark, d, "customer").select("c_custkey", hard.alias("c_name"), "c_acctbal", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("seg"))
    path = _to(spark, "csv")
    sinks.write_csv(df, path)
    return tabular.read(spark, tabular.Source(path + "/")).select("c_custkey", "c_name", "c_acctbal", "seg")


@query(SNAPSHOTS + "SELECT slug, hash FROM fresh")
def state_roundtrip(spark, d):
    """Page hashes through a state's JSON: as many rows as a bundle holds."""
    _, fresh = _snapshots(spark, d)
    none = spark.createDataFrame([], "archetype_id string, hash string, evidence_slugs array<string>, source_query string, quality_score double")
    asked = spark.createDataFrame([], "id string, category string, query string, ord long")
    state = I.state_of({"pages": fresh.select(F.col("slug").cast("string").alias("slug"), "hash"), "chunks": none}, asked, "hash", 64, "t")
    return I.State.from_json(state.to_json()).tables(spark)["pages"].select(F.col("slug").cast("long").alias("slug"), "hash")


@query("SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_custkey LIMIT 7")
def preview_rows(spark, d):
    rows = sinks.preview(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), 7, "c_custkey")
    return spark.createDataFrame([(r["c_custkey"], r["c_mktsegment"]) for r in rows], "c_custkey long, c_mktsegment string")


@query("SELECT 'success' AS status, 1 AS sources, count(*) AS rows_in, count(*) FILTER (n_regionkey > 1) AS rows_out FROM nation")
def final_report(spark, d):
    n = t(spark, d, "nation")
    r = sinks.report([n], n.filter("n_regionkey > 1"), _to(spark, "report"), "json").to_dict()
    return spark.createDataFrame([(r["status"], r["input_sources_count"], r["input_rows_total"], r["output_rows"])], "status string, sources long, rows_in long, rows_out long")


@query("SELECT event_id, event_type, value FROM events")
def json_roundtrip(spark, d):
    path = _to(spark, "json")
    sinks.write_json(t(spark, d, "events").select("event_id", "event_type", "value"), path)
    return tabular.read_json(spark, path).select("event_id", "event_type", "value")


@query("SELECT * FROM supplier")
def parquet_roundtrip(spark, d):
    path = _to(spark, "parquet")
    sinks.write_counted(t(spark, d, "supplier"), path)
    return spark.read.parquet(path)


@query("SELECT r_regionkey AS k, CASE WHEN r_regionkey % 2 = 0 THEN NULL ELSE r_name END AS name FROM region")
def csv_sniff_nulls(spark, d):
    r = t(spark, d, "region")
    lines = r.select(F.concat_ws(";", F.col("r_regionkey").cast("string"), F.when(F.col("r_regionkey") % 2 == 0, "N/A").otherwise(F.col("r_name"))).alias("value"))
    path = _to(spark, "sniff")
    spark.createDataFrame([("k;name",)], "value string").unionByName(lines).coalesce(1).write.text(path)
    return tabular.read_csv(spark, path)


@query("SELECT n_nationkey, n_name FROM nation")
def zip_member(spark, d):
    """The nations, a small table, as a member of an archive."""
    lines = [f"{r[0]},{r[1]}" for r in t(spark, d, "nation").select("n_nationkey", "n_name").collect()]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("notes.txt", "no table")
        z.writestr("data.csv", "\n".join(["n_nationkey,n_name", *lines, ""]))
    name, body = tabular.zip_member(out.getvalue())
    return tabular.read_csv(spark, tabular._stage(spark, shared_dir(spark), name, body)).select("n_nationkey", "n_name")


@query("SELECT 'nation' AS tbl, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def inline_multi_table(spark, d):
    """Two small tables given as records."""
    rows = {n: [r.asDict() for r in t(spark, d, n).collect()] for n in ("nation", "region")}
    tables = tabular.load_named(spark, tabular.sources_of({"inputData": rows}))
    return spark.createDataFrame([(k, v.count()) for k, v in tables.items()], "tbl string, n long")


@query(CORPUS + "SELECT slug, title, body, kind FROM base")
def corpus_roundtrip(spark, d):
    """Pages to markdown text and back through the parser."""
    c = F.col
    head = F.concat(F.lit("---\nslug: "), F.concat(F.lit('"'), c("slug"), F.lit('"')), F.lit('\ntitle: "'), c("title"), F.lit('"\nkind: '), c("kind"), F.lit("\n---\n\n"))
    files = corpus(spark, d).select(F.concat(c("slug"), F.lit(".md")).alias("path"), F.concat(head, c("body"), F.lit("\n")).alias("text"))
    return Co.parsed(files).select("slug", "title", "body", "kind")


@query(CORPUS + "SELECT slug, title, kind FROM base WHERE kind = 'page'")
def bundle_roundtrip(spark, d):
    """A bundle of the regions and nations: a fixed, small number of pages."""
    rows = [r.asDict() for r in corpus(spark, d).filter("kind = 'page'").collect()]
    pages = [{"slug": r["slug"], "title": r["title"], "body": r["body"], "kind": "page", "frontmatter": {"kind": "page"}} for r in rows]
    content = Co.write_bundle(pages, {p["slug"]: [1.0, 0.0] for p in pages}, Co.build_manifest(len(pages), 0, 0, "hash", 2))
    _, got, _, _ = Co.read_bundle(spark, content)
    return got.select("slug", "title", "kind")
