"""The queries over whole tables, one for each operator: thin, under fixed column contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomwork.llm import fingerprint, jaccard_join, kmeans, mixing, nearest, packing, quality, sentencepiece_bpe, spelling, suffix_dedup, tokenfile, toxicity, warc
from loomwork.llm.common import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept", "row")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_documents(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = warc.round_trip(table(spark, sf_dir, "pages"))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = jaccard_join.join(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_shingles", "component_id")


def op6_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = jaccard_join.join(table(spark, sf_dir, "documents"), count_links=True)
    return got.select("doc_id", "n_shingles", "component_id", "n_links")


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_likeness(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans.cluster(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


OP4_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
     k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS keep FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keep THEN keep END AS refers_to
FROM k
"""

OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(sh) AS n FROM documents LEFT JOIN s USING (doc_id) GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT n.doc_id, n.n AS n_shingles, m.component_id FROM n JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY 1) m ON m.x = n.doc_id
"""

# The same rows with the number of other documents that each one is linked to.
OP6_LINKS_SQL = OP6_SQL.replace("SELECT n.doc_id, n.n AS n_shingles, m.component_id FROM", "SELECT n.doc_id, n.n AS n_shingles, m.component_id, (SELECT count(*) FROM l WHERE l.x = n.doc_id) AS n_links FROM")

# crc32 bit by bit from its polynomial; words at one edit by what is left without one letter.
OP12_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce([CAST(b AS BIGINT)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM range(256) r(b)),
o AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{6,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
u AS (SELECT d, r, count(*) AS k, hex(encode(d || ':' || r)) AS x FROM o GROUP BY d, r),
h AS (SELECT r, k, xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(CAST(length(x) / 2 AS BIGINT)), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT)), lambda c, v: xor(c >> 8, t[xor(c & 255, v) + 1])), 4294967295) AS h FROM u, tab),
y AS (SELECT CASE WHEN h % 199 = 0 THEN left(r, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, k FROM h),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM y WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
c AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS v FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
p AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM c a JOIN c b ON a.v = b.v AND a.i = b.i AND a.word <> b.word AND length(a.word) = length(b.word)
      UNION SELECT w.word, w.n, c.word, c.n FROM w JOIN c ON c.v = w.word UNION SELECT c.word, c.n, w.word, w.n FROM w JOIN c ON c.v = w.word),
f AS (SELECT word, n, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM p GROUP BY word, n),
g AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN other END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n FROM w LEFT JOIN f USING (word)),
r AS (SELECT word, word AS root, 0 AS step FROM g UNION ALL SELECT r.word, g.form, step + 1 FROM r JOIN g ON g.word = r.root WHERE g.form IS NOT NULL)
SELECT g.word, form, e.root, n, n_near, form_n FROM g JOIN (SELECT word, arg_max(root, step) AS root FROM r GROUP BY word) e ON e.word = g.word
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": OP4_SQL, "op6_jaccard_join": OP6_SQL, "op6_jaccard_links": OP6_LINKS_SQL, "op12_spelling": OP12_SQL}
