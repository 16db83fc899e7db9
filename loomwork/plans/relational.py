"""Queries of the relational operators over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwork.functions import semantics as S
from loomwork.operators import profile
from loomwork.plans.registry import query, t

# --- projections and filters --------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem")
def proj_select(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_quantity < 10 AND l_discount > 0.05) OR (l_returnflag = 'R' AND l_quantity >= 45)")
def filter_compound(spark, d):
    c = F.col
    df = t(spark, d, "lineitem")
    return df.filter(((c("l_quantity") < 10) & (c("l_discount") > 0.05)) | ((c("l_returnflag") == "R") & (c("l_quantity") >= 45))).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS revenue, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 4) AS charge, CASE WHEN l_discount = 0 THEN 'inf' ELSE 'finite' END AS ratio_text FROM lineitem")
def with_columns_arith(spark, d):
    df = t(spark, d, "lineitem")
    gross = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    ratio = S.divide(F.col("l_tax") + 1, "l_discount")
    return df.select("l_orderkey", "l_linenumber", F.round(gross, 4).alias("revenue"), F.round(gross * (1 + F.col("l_tax")), 4).alias("charge"), F.when(ratio == float("inf"), "inf").otherwise("finite").alias("ratio_text"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'gold' WHEN o_totalprice > 150000 THEN 'silver' ELSE 'bronze' END AS tier FROM orders")
def case_when_tier(spark, d):
    p = F.col("o_totalprice")
    return t(spark, d, "orders").select("o_orderkey", F.when(p > 300000, "gold").when(p > 150000, "silver").otherwise("bronze").alias("tier"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS part_id, CAST(p_size AS DOUBLE) AS size_d, CAST(floor(p_retailprice) AS BIGINT) AS whole_price FROM part")
def cast_rename(spark, d):
    df = t(spark, d, "part").withColumnsRenamed({"p_partkey": "part_id", "p_size": "size_d"})
    return df.select(F.col("part_id").cast("string").alias("part_id"), F.col("size_d").cast("double").alias("size_d"), F.floor("p_retailprice").cast("long").alias("whole_price"))


@query("SELECT c_custkey, c_name FROM customer WHERE nullif(c_mktsegment, 'BUILDING') IS NOT NULL AND nullif(c_nationkey, 3) IS NOT NULL")
def drop_nulls(spark, d):
    df = t(spark, d, "customer").withColumn("seg", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))).withColumn("nat", F.nullif(F.col("c_nationkey"), F.lit(3)))
    return df.na.drop(subset=["seg", "nat"]).select("c_custkey", "c_name")


@query("SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, coalesce(nullif(c_nationkey, 3), -1) AS nat FROM customer")
def fill_null(spark, d):
    df = t(spark, d, "customer").select("c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("seg"), F.nullif(F.col("c_nationkey"), F.lit(3)).alias("nat"))
    return df.na.fill({"seg": "none", "nat": -1})


@query("SELECT o_orderkey, o_orderstatus, nullif(o_orderstatus, 'P') IN ('O', 'F') AS hit FROM orders")
def is_in(spark, d):
    return t(spark, d, "orders").select("o_orderkey", "o_orderstatus", S.contains(F.nullif(F.col("o_orderstatus"), F.lit("P")), ["O", "F"]).alias("hit"))


# --- joins ----------------------------------------------------------------------


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, d):
    return S.join_tables(t(spark, d, "orders"), t(spark, d, "customer"), "o_custkey", "c_custkey").select("o_orderkey", "c_name", "o_totalprice")


@query("SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) ON c_custkey = o_custkey")
def join_left_dropkey(spark, d):
    out = S.join_tables(t(spark, d, "customer"), t(spark, d, "orders").filter("o_totalprice > 200000"), "c_custkey", "o_custkey", "left")
    assert "o_custkey" not in out.columns
    return out.select("c_custkey", "c_name", "o_orderkey")


@query("SELECT c_custkey, o_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) ON c_custkey = o_custkey")
def join_left_keepkey(spark, d):
    out = S.join_tables(t(spark, d, "customer"), t(spark, d, "orders").filter("o_totalprice > 200000"), "c_custkey", "o_custkey", "left", coalesce=False)
    return out.select("c_custkey", "o_custkey", "o_orderkey")


_HALVES = "(SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0) a FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) b ON a.c_custkey = b.o_custkey"


def _halves(spark, d):
    a = t(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey", "c_name")
    return a, t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query(f"SELECT coalesce(c_custkey, o_custkey) AS c_custkey, c_name, n FROM {_HALVES}")
def join_full_coalesce(spark, d):
    return S.join_tables(*_halves(spark, d), "c_custkey", "o_custkey", "full", coalesce=True)


@query(f"SELECT c_custkey, o_custkey, c_name, n FROM {_HALVES}")
def join_full_keep(spark, d):
    return S.join_tables(*_halves(spark, d), "c_custkey", "o_custkey", "full")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, d):
    return t(spark, d, "region").select("r_name").crossJoin(t(spark, d, "nation").select("n_name"))


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'F'")
def join_three_tables(spark, d):
    o = t(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    out = S.join_tables(o, t(spark, d, "customer"), "o_custkey", "c_custkey")
    out = S.join_tables(out, t(spark, d, "nation"), "c_nationkey", "n_nationkey")
    return S.join_tables(out, t(spark, d, "region"), "n_regionkey", "r_regionkey").select("o_orderkey", "c_name", "n_name", "r_name")


@query("SELECT a.n_nationkey AS k, a.n_name AS name, b.r_name AS name_right FROM nation a JOIN region b ON a.n_regionkey = b.r_regionkey")
def join_name_clash_suffix(spark, d):
    a = t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("r"))
    b = t(spark, d, "region").select(F.col("r_regionkey").alias("r"), F.col("r_name").alias("name"))
    return S.join_tables(a, b, "r", "r").drop("r")


# --- aggregates -----------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, min(l_discount) AS min_disc, max(l_discount) AS max_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2")
def group_aggregate(spark, d):
    df = t(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("date"))
    return df.groupBy("l_returnflag", "l_linestatus").agg(
        S.sum0("l_quantity").alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.min("l_discount").alias("min_disc"), F.max("l_discount").alias("max_disc"), F.count(F.lit(1)).alias("n")
    )


@query("SELECT nullif(o_orderstatus, 'P') AS status, count(nullif(o_orderpriority, '1-URGENT')) AS n_known, count(*) AS n_rows FROM orders GROUP BY 1")
def agg_count_len(spark, d):
    df = t(spark, d, "orders").select(F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("status"), F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT")).alias("p"))
    return df.groupBy("status").agg(F.count("p").alias("n_known"), F.count(F.lit(1)).alias("n_rows"))


@query("SELECT c_nationkey, count(DISTINCT nullif(c_mktsegment, 'BUILDING')) + max(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) AS n_segments FROM customer GROUP BY 1")
def agg_nunique_nullaware(spark, d):
    df = t(spark, d, "customer").select("c_nationkey", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("s"))
    return df.groupBy("c_nationkey").agg(S.n_unique("s").cast("long").alias("n_segments"))


@query("SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS first_price, arg_max(o_totalprice, o_orderkey) AS last_price FROM orders GROUP BY 1")
def agg_first_last_ordered(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg(S.first_by("o_totalprice", "o_orderkey").alias("first_price"), S.last_by("o_totalprice", "o_orderkey").alias("last_price"))


@query("SELECT event_type, round(stddev_samp(value), 4) AS sd, round(var_samp(value), 4) AS var FROM events GROUP BY 1")
def agg_std_var(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.round(F.stddev_samp("value"), 4).alias("sd"), F.round(F.var_samp("value"), 4).alias("var"))


@query("SELECT coalesce(sum(l_quantity), 0) AS s, count(*) AS n FROM lineitem WHERE l_quantity < 0")
def agg_sum_zero_on_empty(spark, d):
    return t(spark, d, "lineitem").filter("l_quantity < 0").agg(S.sum0("l_quantity").alias("s"), F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 2) AS total FROM events")
def agg_global(spark, d):
    return t(spark, d, "events").agg(F.count(F.lit(1)).alias("n"), S.n_unique("user_id").cast("long").alias("users"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT n_name, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY total DESC, n_name LIMIT 20")
def topn_group_sum(spark, d):
    df = t(spark, d, "customer").groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("s"))
    df = df.join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return df.select("n_name", F.round("s", 2).alias("total")).orderBy(F.desc("total"), "n_name").limit(20)


# --- windows --------------------------------------------------------------------


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS of_customer FROM orders")
def win_sum_over(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(Window.partitionBy("o_custkey")), 2).alias("of_customer"))


@query("SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_orderkey, l_quantity) - 1) / 2.0 AS rk FROM lineitem")
def win_rank_avg(spark, d):
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.rank_average("l_quantity", "l_orderkey").alias("rk"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders")
def win_running_total(spark, d):
    return t(spark, d, "orders").select("o_orderkey", F.round(S.running_total("o_totalprice", ["o_custkey"], ["o_orderdate", "o_orderkey"]), 2).alias("running"))


# --- order ----------------------------------------------------------------------


@query("SELECT c_custkey, row_number() OVER (ORDER BY nullif(c_mktsegment, 'BUILDING') DESC NULLS FIRST, c_acctbal ASC, c_custkey) AS row_nr FROM customer")
def sort_mixed_nulls(spark, d):
    df = t(spark, d, "customer").withColumn("s", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")))
    return S.with_row_number(df, [S.nulls_first("s", True), S.nulls_first("c_acctbal"), F.col("c_custkey").asc()]).select("c_custkey", "row_nr")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def head_n(spark, d):
    return S.head(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), 25, [F.desc("o_totalprice"), F.col("o_orderkey")])


@query("SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 15) ORDER BY o_orderkey")
def tail_n(spark, d):
    return S.head(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), 15, [F.desc("o_orderkey")]).orderBy("o_orderkey")


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def unique_subset(spark, d):
    return t(spark, d, "lineitem").dropDuplicates(["l_returnflag", "l_linestatus", "l_linenumber"]).select("l_returnflag", "l_linestatus", "l_linenumber")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 100")
def slice_rows(spark, d):
    return S.slice_rows(t(spark, d, "orders").select("o_orderkey", "o_custkey"), [F.col("o_orderkey").asc()], 100, 20)


# --- unions ---------------------------------------------------------------------


@query("SELECT CAST(r_regionkey AS VARCHAR) AS id, r_name AS name, NULL::INT AS region FROM region UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), n_name, n_regionkey FROM nation")
def union_diagonal_relaxed(spark, d):
    a = t(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    b = t(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    return profile.union_relaxed([a, b])


@query("SELECT c_custkey AS k, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def concat_vertical(spark, d):
    a = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return a.unionByName(t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")))


# Columns and their types as the catalogue has them, named as this library's sources name them.
_COLUMNS = """
WITH one AS (SELECT 'r_regionkey' AS c, typeof(r_regionkey) AS k FROM region UNION SELECT 'name', 'INTEGER'),
     two AS (SELECT 'n_nationkey' AS c, typeof(n_nationkey) AS k FROM nation UNION SELECT 'name', typeof(n_name) FROM nation UNION SELECT 'n_regionkey', typeof(n_regionkey) FROM nation),
     kinds AS (SELECT CASE k WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' ELSE lower(k) END AS s, k FROM (SELECT k FROM one UNION SELECT k FROM two))
"""


@query(_COLUMNS + """
SELECT 'table 2 also has ' || string_agg(c, ', ' ORDER BY c) AS warning FROM two WHERE c NOT IN (SELECT c FROM one)
UNION ALL SELECT 'table 2 lacks ' || string_agg(c, ', ' ORDER BY c) FROM one WHERE c NOT IN (SELECT c FROM two)
UNION ALL SELECT 'table 2 has ' || c || ' as ' || b.s || ', not ' || a.s FROM one JOIN two USING (c) JOIN kinds a ON a.k = one.k JOIN kinds b ON b.k = two.k WHERE one.k <> two.k
""")  # fmt: skip
def schema_warnings(spark, d):
    a = t(spark, d, "region").select("r_regionkey", F.lit(1).alias("name"))
    b = t(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("name"), "n_regionkey")
    return spark.createDataFrame([(w,) for w in profile.schema_warnings([a, b])], "warning string")


# --- profiles -------------------------------------------------------------------


@query("SELECT 'c_custkey' AS name, count(*) AS n_rows, count(*) - count(c_custkey) AS n_nulls FROM customer UNION ALL SELECT 'seg', count(*), count(*) - count(nullif(c_mktsegment, 'BUILDING')) FROM customer")
def profile_nulls(spark, d):
    return profile.nulls(t(spark, d, "customer").select("c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("seg")))


@query("SELECT 'n_name' AS name, (SELECT list(n_name ORDER BY n_nationkey) FROM nation WHERE n_nationkey < 5) AS samples UNION ALL SELECT 'n_regionkey', (SELECT list(CAST(n_regionkey AS VARCHAR) ORDER BY n_nationkey) FROM nation WHERE n_nationkey < 5) UNION ALL SELECT 'n_nationkey', (SELECT list(CAST(n_nationkey AS VARCHAR) ORDER BY n_nationkey) FROM nation WHERE n_nationkey < 5)")
def profile_samples(spark, d):
    return profile.samples(t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), "n_nationkey")


@query("SELECT round(count(*) * (8 + 8 + 50 + 8 + 8 + 50) / 1048576.0, 6) AS mb FROM orders")
def profile_size(spark, d):
    df = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    per_row = profile.size_mb(df.schema, 1) * 2**20
    return df.agg(F.round(F.count(F.lit(1)) * per_row / 1048576.0, 6).alias("mb"))


# --- scalar namespaces ----------------------------------------------------------


@query("SELECT p_partkey, upper(p_name) AS up, length(p_name) AS len, substr(p_brand, 1, 6) AS head, contains(p_type, 'STEEL') AS steel, replace(p_name, ' ', '_') AS snake FROM part")
def str_ops(spark, d):
    return t(spark, d, "part").select("p_partkey", F.upper("p_name").alias("up"), F.length("p_name").cast("long").alias("len"), F.substring("p_brand", 1, 6).alias("head"), F.col("p_type").contains("STEEL").alias("steel"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("snake"))


@query("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS dd, quarter(o_orderdate) AS q, CAST(date_trunc('month', o_orderdate) AS DATE) AS first_day FROM orders")
def dt_ops(spark, d):
    c = F.col("o_orderdate")
    return t(spark, d, "orders").select("o_orderkey", F.year(c).cast("long").alias("y"), F.month(c).cast("long").alias("m"), F.dayofmonth(c).cast("long").alias("dd"), F.quarter(c).cast("long").alias("q"), F.trunc(c.cast("date"), "month").alias("first_day"))


@query("SELECT p_partkey, len(string_split(p_name, ' ')) AS n_words, string_split(p_name, ' ')[1] AS first_word, list_sort(string_split(p_name, ' ')) AS words FROM part")
def list_ops(spark, d):
    w = F.split("p_name", " ")
    return t(spark, d, "part").select("p_partkey", F.size(w).cast("long").alias("n_words"), F.element_at(w, 1).alias("first_word"), F.array_sort(w).alias("words"))


@query("SELECT c_custkey, upper(c_name) AS name, c_acctbal * 2 AS twice FROM customer")
def struct_ops(spark, d):
    df = t(spark, d, "customer").select("c_custkey", F.struct(F.upper("c_name").alias("name"), (F.col("c_acctbal") * 2).alias("twice")).alias("s"))
    return df.select("c_custkey", "s.name", "s.twice")


@query("SELECT event_id, json_valid(props) AS ok, len(json_keys(props)) AS n_keys FROM events")
def json_props(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$").isNotNull().alias("ok"), F.size(F.json_object_keys("props")).cast("long").alias("n_keys"))
