"""What a query written elsewhere may name, judged by what it has become once analysed."""

import pytest

from loomwork.plans import gate


@pytest.fixture(scope="module")
def given(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    secret = spark.createDataFrame([("s", 7)], "k string, v int")
    secret.createOrReplaceTempView("secret_other")
    secret.createOrReplaceGlobalTempView("secret_global")
    spark.sql("DROP TABLE IF EXISTS secret_saved")
    secret.write.mode("overwrite").saveAsTable("secret_saved")
    spark.sql("CREATE OR REPLACE VIEW secret_view AS SELECT * FROM secret_saved")
    yield {"t": t, "my table": t.filter("v = 2")}
    spark.sql("DROP VIEW secret_view")
    spark.sql("DROP TABLE secret_saved")


@pytest.mark.parametrize(
    "query",
    [
        "SELECT * FROM IDENTIFIER('secret_other')",
        "SELECT * FROM IDENTIFIER('secret' || '_other')",
        "SELECT * FROM df_t WHERE k IN (SELECT k FROM IDENTIFIER('secret_other'))",
        "SELECT (SELECT max(v) FROM IDENTIFIER('secret_' || 'other')) AS m FROM df_t",
        "WITH x AS (SELECT * FROM IDENTIFIER('secret_saved')) SELECT * FROM x",
        "SELECT * FROM IDENTIFIER('default.secret_saved')",
        "SELECT * FROM IDENTIFIER('secret_view')",
        "SELECT * FROM IDENTIFIER('global_temp.secret_global')",
        "SELECT * FROM IDENTIFIER('parquet.`/root/testdata/sf0.001/nation.parquet`')",
        "SELECT * FROM range(3)",
        "SELECT * FROM df_t, range(3)",
        "SELECT * FROM df_t WHERE v IN (SELECT id FROM range(3))",
        "SELECT * FROM sql_keywords()",
        "SELECT IDENTIFIER('reflect')('java.lang.System', 'getenv', 'HOME') AS x FROM df_t",
        "SELECT IDENTIFIER('java' || '_method')('java.lang.System', 'currentTimeMillis') AS x",
        "SELECT k, IDENTIFIER('input_file_name')() AS f FROM df_t",
        "SELECT struct(v, upper(IDENTIFIER('try_reflect')('java.lang.System', 'currentTimeMillis'))) AS m FROM df_t",
    ],
)
def test_names_that_are_not_given(spark, given, query):
    with pytest.raises(gate.Rejected):
        gate.run_sql(spark, given, query)


@pytest.mark.parametrize(
    "query,rows",
    [
        ("SELECT * FROM IDENTIFIER('df_' || 't')", 2),
        ("SELECT a.k, b.v FROM df_t a LEFT JOIN df_my_table b USING (k) WHERE a.v IN (SELECT v FROM df)", 2),
        ("WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r WHERE n < 4) SELECT n, (SELECT count(*) FROM df_t) AS c FROM r", 4),
        ("SELECT * FROM df_t PIVOT (sum(v) FOR k IN ('a', 'b'))", 1),
        ("SELECT k, x FROM df_t LATERAL VIEW explode(array(1, 2)) e AS x", 4),
        ("SELECT k, x FROM df_t, LATERAL (SELECT v + 1 AS x)", 2),
        ("SELECT * FROM VALUES (1), (2), (3) AS t(a)", 3),
        ("SELECT k, row_number() OVER (ORDER BY v) AS n FROM df_t UNION SELECT k, v FROM df_t ORDER BY n LIMIT 3 OFFSET 1", 1),
        ("SELECT k, v, count(*) AS n FROM df_t GROUP BY CUBE (k, v) HAVING count(*) > 0", 7),
        ("SELECT DISTINCT k FROM df_t EXCEPT SELECT k FROM df_my_table", 1),
    ],
)
def test_queries_over_given_tables(spark, given, query, rows):
    assert gate.run_sql(spark, given, query).count() == rows


def test_the_callers_session_is_left_alone(spark, given):
    before = {v.name for v in spark.catalog.listTables()}
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        got = gate.run_sql(spark, given, "SELECT date_format(timestamp_seconds(0), 'HH') AS h, k FROM df_t")
        assert {r.h for r in got.collect()} == {"09"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert {v.name for v in spark.catalog.listTables()} == before
    # a result is an ordinary frame of the caller's session
    joined = got.join(given["t"], "k")
    assert joined.count() == 2 and joined.sparkSession is spark
