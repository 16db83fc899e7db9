import json

import pytest
from pyspark.sql import functions as F

from loomwork.functions import semantics as S, text as Tx
from loomwork.operators import contracts as C, incremental as I, links, store as St, vector_joins, vectors as V
from loomwork.operators.table_store import TableStore
from loomwork.plans import gate
from loomwork.service import PROMPTS, KnowledgeBase, prompt
from loomwork.streaming.sync import sync_stream, window_counts


# --- semantics where defaults differ ----------------------------------------------


def test_null_aware_helpers(spark):
    df = spark.createDataFrame([(1, None, 1.0), (1, "a", 0.0), (1, "a", -2.0), (2, None, None)], "k int, s string, x double")
    got = {r.k: tuple(r)[1:] for r in df.groupBy("k").agg(S.n_unique("s"), S.sum0("x"), S.null_count("s")).collect()}
    assert got == {1: (2, -1.0, 1), 2: (1, 0.0, 1)}
    ranks = [r[0] for r in spark.createDataFrame([(1,), (1,), (3,), (None,)], "v int").select("v", S.rank_average("v").alias("r")).orderBy(F.col("v").asc_nulls_last()).select("r").collect()]
    assert ranks == [1.5, 1.5, 3.0, None]
    d = [r[0] for r in spark.createDataFrame([(1, 1.0, 0.0), (2, -1.0, 0.0), (3, 4.0, 2.0)], "o int, a double, b double").orderBy("o").select(S.divide("a", "b")).collect()]
    assert d == [float("inf"), float("-inf"), 2.0]


def test_joins(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "q"), (3, "r")], "r int, v string")
    assert S.join_tables(a, b, "k", "r").columns == ["k", "v", "v_right"]
    assert sorted(map(str, (r.k for r in S.join_tables(a, b, "k", "r", "full", coalesce=True).collect()))) == ["1", "2", "3"]
    assert S.join_tables(a, b, "k", "r", "left", coalesce=False).columns == ["k", "v", "r", "v_right"]
    same = spark.createDataFrame([(2, "z")], "k int, v string")
    assert [tuple(r) for r in S.join_tables(a, same, "k", "k").collect()] == [(2, "y", "z")]


def test_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()[0]
    for given, want in (("Täglich / Neu", "t-glich-neu"), ("--9 Lives--", "9-lives"), ("a" * 60, "a" * 45), ("_", "wiki"), ("", "wiki")):
        assert one(Tx.index_name(F.lit(given))) == want
    assert one(Tx.body_links(F.lit("[[x/y|]] [[ x/z |label]][[x/z]] [[|no]] [x]"))) == one(Tx.body_links(F.lit("[[ x/z |label]][[x/z]]")))
    for slug in ("ä b/c", "a+b&c=d", "x"):
        assert one(Tx.uri_to_slug(Tx.slug_to_uri(F.lit(slug)))) == slug
    assert one(Tx.uri_to_slug(F.lit("mailto:x"))) is None and one(Tx.uri_to_slug(F.lit(None).cast("string"))) is None
    assert one(Tx.archetype_id(F.lit("predictive"), F.lit("  Will it RAIN, soon?"))) == "predictive--will-it-rain-soon"
    assert one(Tx.safe_path(F.lit("//"))) == "page" and one(Tx.is_blank(F.lit("\u2003\t"))) is True and one(Tx.is_blank(F.lit("0"))) is False


# --- vectors ------------------------------------------------------------------------


def test_topk_and_duplicates(spark):
    rows = [(9, [3.0, 4.0]), (4, [3.0, 4.0]), (7, [4.0, -3.0]), (2, [0.3, 0.4]), (5, [0.0, 0.0]), (6, None)]
    df = spark.createDataFrame(rows, "slug long, embedding array<float>")
    ask = [0.6, 0.8]
    assert [r.slug for r in V.topk(df, ask, 2).collect()] == [4, 9]  # ties by id
    near = [(r.slug, round(abs(r.score), 5)) for r in V.topk(df, ask, 9, metric=V.cosine).collect()]
    assert sorted(near[:3]) == [(2, 1.0), (4, 1.0), (9, 1.0)] and near[3:] == [(7, 0.0)]
    assert V.topk_postfiltered(df, ask, 1, F.col("slug") == 7).count() == 0 and V.topk_postfiltered(df, ask, 2, F.col("slug") == 7).count() == 1
    unit = df.filter("slug in (4, 7, 9)").select("slug", F.transform("embedding", lambda x: x / 5).alias("embedding"))
    assert {(r.query_id, r.id) for r in vector_joins.near_duplicates(unit, 0.999, "slug").collect()} == {(4, 9), (9, 4)}
    e = V.HashingEmbedder(32)
    assert e.query("x y") == e.query("x  y") and abs(sum(v * v for v in e.query("hello world")) - 1) < 1e-5
    assert e.table(spark.createDataFrame([("hello",), (None,)], "t string"), "t").count() == 2


def test_a_models_limits(spark):
    """Calls of bounded size, a budget of tokens in a minute, and waits that grow when the model asks for them."""
    now, waited, sizes, fail = [0.0], [], [], [2]

    def sleep(s):
        waited.append(s)
        now[0] += s

    def ask(texts, kind):
        if fail[0]:
            fail[0] -= 1
            raise RuntimeError("HTTP 429")
        sizes.append((len(texts), kind))
        return [[float(len(t)), 1.0] for t in texts]

    m = V.ModelEmbedder(ask, 2, texts=4, tokens=10, sleep=sleep, clock=lambda: now[0])
    assert m.embed(["a" * 4] * 9 + [None]).shape == (10, 2) and sizes == [(4, "passage"), (4, "passage"), (2, "passage")]
    assert waited[:2] == [V.FIRST_WAIT, 2 * V.FIRST_WAIT] and now[0] >= 90
    assert m.query("abc") == [3.0, 1.0] and sizes[-1] == (1, "query")
    fail[0] = 99
    with pytest.raises(RuntimeError, match="asked to wait"):
        m.embed(["x"])
    with pytest.raises(KeyError):
        V.ModelEmbedder(lambda texts, kind: {}[kind], 2).embed(["x"])
    rows = V.ModelEmbedder(lambda texts, kind: [[1.0, 0.0]] * len(texts), 2).table(spark.createDataFrame([("x",), (None,)], "t string"), "t")
    assert [r.embedding for r in rows.collect()] == [[1.0, 0.0]] * 2


# --- incremental ----------------------------------------------------------------------


def test_diff_and_staleness(spark):
    t = lambda rows, s: spark.createDataFrame(rows, s)
    hashes = "slug long, hash string"
    d = I.diff_pages(t([(1, "x"), (2, "x"), (3, "z"), (4, "y")], hashes), t([(1, "x"), (2, "X"), (3, ""), (6, "y")], hashes))
    status = {r.slug: r.status for r in d.collect()}
    assert status == {1: "unchanged", 2: "changed", 3: "changed", 4: "removed", 6: "added"}
    assert sorted(r[0] for r in I.touched(d).collect()) == [2, 3, 4] and I.changed_fraction(d).first()[0] == 1.0
    assert I.changed_fraction(d.filter("status = 'added'")).first()[0] == 1.0 and I.changed_fraction(d.limit(0)).first()[0] == 1.0
    chunks = t([(10, [1, 1]), (11, [4, 2, 4]), (12, []), (13, None), (14, [99])], "chunk_id long, evidence_slugs array<long>")
    assert [r[0] for r in I.stale_by_overlap(chunks, I.touched(d)).collect()] == [11]
    now = t([(10, 1), (11, 2), (11, 4), (14, 98), (15, 1)], "chunk_id long, slug long")
    assert [r[0] for r in I.stale_by_drift(chunks, now).collect()] == [14]  # order and repeats do not matter
    gone = t([(4,), (2,), (4,)], "slug long")
    assert {tuple(r) for r in I.split_stale(chunks, gone).collect()} == {(10, "regenerate"), (11, "drop"), (12, "regenerate"), (13, "regenerate"), (14, "regenerate")}
    pages = t([(1, "a"), (2, "b"), (6, "c"), (8, "d"), (7, "\t"), (9, None)], "slug long, content_full string")
    assert sorted(r[0] for r in I.pages_needing_embed(pages, d, t([(1,), (1,), (2,)], "slug long")).collect()) == [2, 6, 8]
    v = lambda rows: t(rows, "slug long, embedding array<double>")
    order = t([(3, 0), (1, 1), (5, 2), (2, 3)], "slug long, ord int")
    got = I.stack_vectors(order, v([(5, [0.5]), (1, [0.1])]), v([(1, [9.0]), (2, [0.2])])).orderBy("ord").collect()
    assert [(r.slug, r.source, r.embedding) for r in got] == [(1, "fresh", [0.1]), (5, "fresh", [0.5]), (2, "prior", [0.2])]
    modes = [I.decide(*x).mode for x in ((None, "m", 0.0), ("n", "m", 0.0), ("m", "m", 0.3001), ("m", "m", 0.3), ("m", "m", 0.0))]
    assert modes == ["full", "full", "full", "incremental", "incremental"]
    told = I.report(d, I.split_stale(chunks, gone), I.touched(d), None, chunks).first().asDict()
    assert len(told) == 12 and told["pages_embedded"] == 3 and told["chunks_carried"] == 0 and told["chunks_new"] == 5 and told["changed_fraction"] == 1.0 and told["thesis_reused"]


def test_rows_are_numbered_by_range(spark):
    df = spark.createDataFrame([(k % 7, k) for k in range(500)], "a long, b long")
    got = S.with_row_number(df, [F.col("a").desc(), F.col("b").asc()]).collect()
    want = sorted(((k % 7, k) for k in range(500)), key=lambda r: (-r[0], r[1]))
    assert {(r.a, r.b): r.row_nr for r in got} == {x: i for i, x in enumerate(want, 1)}


# --- memory ------------------------------------------------------------------------------


def test_runs_are_saved(spark, tmp_path):
    from loomwork.operators import memory

    schema = "prompt string, code string, success boolean, execution_time_ms long, output_rows long, attempts int, requested_columns array<string>, output_columns array<string>, used_rag boolean, validator_passed boolean"
    runs = spark.createDataFrame([("sum", "df.head(1)", True, 5, 1, 1, ["a"], ["A"], False, True), ("avg", "x", False, 9, 0, 2, None, None, None, None)], schema)
    store, e = TableStore(spark, str(tmp_path / "m")), V.HashingEmbedder(16)
    rows = {r.namespace: r for r in memory.save(store, "runs", runs, e).collect()}
    assert rows["success"].quality_score == 100.0 and rows["failure"].quality_score == 10.0 and rows["success"].operations == ["head"]
    kept = store.read("runs", "success").first()
    assert kept.id == rows["success"].id and kept.reuse_count == 0 and store.read("runs", "failure").count() == 1
    memory.count_reuse(store, "runs", "success", spark.createDataFrame([(kept.id,)] * 2, "id string"))
    assert store.read("runs", "success").first().reuse_count == 2
    assert [r.id for r in memory.search(store.read("runs", "success"), e.query("sum\nColumns: a")).collect()] == [kept.id]


# --- graph ------------------------------------------------------------------------------


def test_graph(spark):
    e = spark.createDataFrame([(str(a), str(b)) for a, b in [(1, 2), (2, 3), (3, 1), (4, 3), (5, 5), (6, 4)]], "src string, dst string")
    assert sorted(r[0] for r in links.backlinks(e, "3").collect()) == ["2", "4"] and [r[0] for r in links.forward_links(e, "3").collect()] == ["1"]
    assert {tuple(r) for r in links.neighborhood(e, "1", 3).collect()} == {(1, "2"), (1, "3"), (2, "4"), (3, "6")}
    assert links.neighborhood(e, "7", 3).count() == 0


# --- contracts and gate ---------------------------------------------------------------------


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, None, 7.0), (3, "b", 6.0)], "o int, Name string, x double")
    c = C.parse_contract('```json\n{"expected_rows_range": [1, 2], "required_columns": ["NAME", "gone"], "non_null_columns": ["name"], "value_constraints": {"x": {"max": 6, "must_be_unique": true}, "name": {"allowed_values": ["a"]}}, "monotonicity": {"x": "asc", "o": "asc", "y": "up"}}\n```')
    v = C.verify(df, c, "o")
    assert [f.split(":")[0] for f in v.failures] == ["rows_range", "required_columns", "non_null", "value_max[x]", "value_allowed[Name]", "monotonicity[x]"]
    assert not v.passed and v.score == round(100 * (7 - 6) / 7, 2)
    assert C.verify(df, C.parse_contract("junk")) == C.Verdict(True, (), 100.0)
    assert C.verify(df.limit(0), C.Contract(values={"x": C.ValueRule(min=9)})).passed
    assert not C.check_semantics(df.withColumn("n", F.lit(None).cast("int"))).passed and C.check_semantics(df.limit(0)).passed
    assert C.check_semantics(df, "a IN (b.collect ( ))").failures[0].startswith("idiom")


def test_order_is_checked_with_and_without_a_key(spark):
    up = C.Contract(order={"x": "asc"})
    rows = [(k, None if k < 3 else float(k)) for k in range(200)]
    df = spark.createDataFrame(rows, "o int, x double")
    assert C.verify(df.orderBy("o"), up).passed and C.verify(df.repartition(7), up, "o").passed  # nulls first
    assert not C.verify(df.orderBy(F.desc("o")), up).passed and C.verify(df.filter("o >= 3").orderBy(F.desc("o")), C.Contract(order={"x": "desc"})).passed
    late = spark.createDataFrame([*rows, (200, 5.0)], "o int, x double")
    assert not C.verify(late.orderBy("o"), up).passed and not C.verify(late.repartition(5), up, "o").passed
    assert not C.verify(spark.createDataFrame([*rows, (200, None)], "o int, x double"), up, "o").passed
    assert C.verify(df.limit(1), up).passed and C.verify(df.limit(0), up).passed


def test_values_that_cannot_be_compared(spark):
    df = spark.createDataFrame([("b", 1), ("b", 2)], "s string, k int")
    got = C.failures(df, C.Contract(values={"s": C.ValueRule(min=1, unique=True), "k": C.ValueRule(max=1, allowed=("x", 1))}))
    assert [f.split(":")[0] for f in got] == ["value_max[k]", "value_allowed[k]"]


def test_contracts_from_a_model():
    asked = []
    got = C.contract_for("top 3", "t(a int)", lambda p: (asked.append(p), '{"expected_rows_range": [3, 3]}')[1])
    assert got.rows == (3, 3) and "top 3" in asked[0] and "t(a int)" in asked[0]
    assert C.contract_for("x", "", lambda p: 1 / 0) == C.Contract() and C.contract_for("x", "", lambda p: "no") == C.Contract()


@pytest.mark.parametrize("bad", ["DROP TABLE df_t", "SELECT reflect('java.lang.System', 'exit', '0')", "SELECT * FROM parquet.`/etc`", "INSERT INTO x SELECT 1", "SET a=b", "SELEC 1", "CREATE VIEW v AS SELECT 1"])
def test_gate_refuses(spark, bad):
    with pytest.raises(gate.Rejected):
        gate.check_sql(spark, bad)


def test_only_given_tables_are_read(spark):
    t = spark.createDataFrame([("a", 1)], "k string, v int")
    t.createOrReplaceTempView("secret_other")
    run = lambda q: gate.run_sql(spark, {"t": t}, q).count()
    assert run("SELECT * FROM DF_T") == run("SELECT * FROM df") == run("WITH a AS (SELECT * FROM df_t), b AS (SELECT * FROM a) SELECT * FROM b") == 1
    for q in (
        "SELECT * FROM secret_other",
        "SELECT * FROM df_t WHERE v IN (SELECT v FROM secret_other)",
        "SELECT (SELECT max(v) FROM secret_other) FROM df_t",
        "SELECT * FROM df_t JOIN (SELECT * FROM secret_other) USING (k)",
        "WITH a AS (SELECT * FROM secret_other) SELECT * FROM a",
        "SELECT * FROM (WITH secret_other AS (SELECT 1) SELECT * FROM secret_other) JOIN secret_other",
        "SELECT * FROM default.df_t",
    ):
        with pytest.raises(gate.Rejected):
            run(q)


def test_gate_runs_and_retries(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert gate.run_sql(spark, {"t": t}, "WITH x AS (SELECT * FROM df_t) SELECT k, 'drop reflect(' AS s FROM x ORDER BY v LIMIT 1").count() == 1
    script = iter(["SELECT nope FROM df_t", "SELECT k, v FROM df_t WHERE v > 9", "SELECT k, v FROM df_t"])
    seen = []
    out = gate.run_with_retries(spark, {"t": t}, lambda a: (seen.append(len(a)), next(script))[1], C.Contract(rows=(1, None)))
    assert seen == [0, 1, 2] and out.text == "SELECT k, v FROM df_t" and out.attempts[0].diagnosis.kind == "column_not_found" and not out.attempts[1].verdict.passed
    assert gate.run_with_retries(spark, {"t": t}, lambda a: "DROP TABLE x", retries=1).result is None
    slow = "WITH n AS (SELECT explode(sequence(1, 100000)) AS i FROM df_t) SELECT count(*) AS n FROM n a JOIN n b ON sqrt(a.i) + sqrt(b.i) < 0 JOIN n c ON sqrt(a.i + b.i + c.i) < 0"
    late = gate.run_with_retries(spark, {"t": t}, lambda a: slow, retries=0, seconds=2)
    assert late.result is None and late.attempts[0].diagnosis.kind == "timeout"


def test_diagnoses(spark):
    t = spark.createDataFrame([("a", 1)], "customer_name string, total int")

    def kind(q):
        try:
            gate.run_sql(spark, {"t": t}, q).collect()
        except Exception as e:
            return gate.diagnose(e, q)

    assert "customer_name" in kind("SELECT custmer_name FROM df_t").suggestion
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        assert kind("SELECT Total FROM df_t").kind == "case_mismatch"
    finally:
        spark.conf.unset("spark.sql.caseSensitive")
    assert kind("SELECT a.total, u.total FROM df_t a LEFT SEMI JOIN df_t u ON a.total = u.total").kind == "join_key"
    assert kind("df[df.x > 1]").kind == "foreign_syntax" and kind("").kind == "missing_result" and kind("SELECT TOP 5 * FROM df_t").kind == "foreign_syntax"
    assert kind("SELECT CAST('x' AS INT) FROM df_t").kind == "type_mismatch" and kind("SELECT * FROM other").kind == "rejected"


def test_generation_and_errors(spark):
    from loomwork import errors as E, generation as G

    answers = iter(["", "df.groupby('a')", "DROP TABLE x", "```sql\nSELECT 1\n```"])
    seen = []
    service = G.Service(lambda i, p: (seen.append(p), next(answers))[1], lambda i, p: next(answers), spark=spark)
    got = service.generate("count", "t(a int)")
    assert got.code == "SELECT 1" and got.model == "fallback" and got.attempts == 4 and len(service.failures) == 3 and "groupby" in seen[2] and got.to_dict()["tokens"] > 0
    with pytest.raises(E.GenerationFailed) as failed:
        G.Service(lambda i, p: "").generate("x")
    assert failed.value.context.recoverable and failed.value.to_dict()["details"]["attempts"] == 3
    t = spark.createDataFrame([(1,)], "a int")
    script = iter(["SELECT b FROM df_t", "SELECT a FROM df_t"])
    out = gate.run_with_retries(spark, {"t": t}, G.Service(lambda i, p: next(script)).for_retries("a's"))
    assert out.text == "SELECT a FROM df_t" and len(out.attempts) == 2
    kinds = [type(E.wrapped(e)) for e in (gate.Rejected("x"), gate.TimeLimit("x"), MemoryError(), FileNotFoundError("f"), ValueError("v"), KeyError("k"))]
    assert kinds == [E.Forbidden, E.TookTooLong, E.OutOfMemory, E.LoadFailed, E.InvalidInput, E.EngineError]
    assert not E.wrapped(gate.Rejected("no")).context.recoverable and "Suggestion" in E.wrapped(ValueError("v")).user_message
    try:
        spark.sql("SELECT nope FROM range(1)")
    except Exception as e:
        assert isinstance(E.wrapped(e), E.QueryFailed)


# --- store and streams ------------------------------------------------------------------------


def test_store_on_disk(spark, tmp_path):
    s = TableStore(spark, str(tmp_path / "store"))
    rows = lambda *ids: spark.createDataFrame([(i, 1) for i in ids], "id string, v int")
    ids = lambda tenant: {r.id for r in s.read("c", tenant).collect()}
    s.sync("c", "acme", rows("old"))
    s.sync("c", "acme", rows("a", "b"), reset=True)
    assert ids("acme") == {"a", "b"}
    s.sync("c", "globex", rows("a", "c"))
    s.sync("c", "globex", rows("b"), rows("c").select("id"))
    assert ids("globex") == {"a", "b"} and ids("acme") == {"a", "b"}
    assert not s.sync("c", None, rows("x")).enabled
    s.delete("c", "acme")
    assert s.read("c", "acme") is None
    s.delete("c", "nobody")
    with pytest.raises(ValueError):
        s.upsert("c", "", rows("x"))


def test_trim_and_increment(spark):
    df = spark.createDataFrame([(str(i), float(i), 10 if i == 0 else 0) for i in range(20)], "id string, quality_score double, reuse_count int")
    assert {r.id for r in df.join(St.trim(df, clean_at=20), "id", "left_anti").collect()} == {"1", "2"} and St.trim(df, clean_at=21).count() == 20
    more = St.increment(df, spark.createDataFrame([("1",), ("1",)], "id string"))
    assert more.filter("id = '1'").first().reuse_count == 2


def test_stream_sync_is_idempotent(spark, tmp_path):
    src = str(tmp_path / "in")
    put = lambda rows: spark.createDataFrame(rows, "id string, version long, text string, deleted boolean").coalesce(1).write.mode("append").json(src)
    put([("a", 1, "x", False), ("a", 2, "y", False), ("b", 1, "z", False)])
    s = TableStore(spark, str(tmp_path / "store"))
    stream = lambda: spark.readStream.schema("id string, version long, text string, deleted boolean").json(src)
    go = lambda: sync_stream(stream(), s, "c", "t", str(tmp_path / "cp"), once=True).awaitTermination(120)
    go()
    assert {(r.id, r.text) for r in s.read("c", "t").collect()} == {("a", "y"), ("b", "z")}
    put([("b", 2, None, True), ("a", 1, "late", False)])
    go()
    assert {(r.id, r.text) for r in s.read("c", "t").collect()} == {("a", "y")}
    ev = spark.readStream.schema("ts timestamp, event_type string, value double").json(str(tmp_path / "in"))
    assert window_counts(ev).isStreaming


# --- service ------------------------------------------------------------------------------------


def test_service(spark):
    fm = lambda kind, **kw: {"kind": kind, **kw}
    rows = [("pages/alpha", "Alpha", "core concept", "page", fm("page"), 0), ("pages/beta", "Beta", "practical follow up", "page", fm("page"), 1), ("chunks/top", "Top", "alpha beta gamma", "chunk", fm("chunk", cites='["pages/alpha"]', teacher="m"), 2)]
    pages = spark.createDataFrame(rows, "slug string, title string, body string, kind string, frontmatter map<string,string>, page_ord long")
    e = V.HashingEmbedder(64)
    vectors = e.table(pages.select("slug", "body"), "body").select("slug", "embedding")
    kb = KnowledgeBase(pages, vectors, spark.createDataFrame([("pages/beta", "pages/alpha")], "src string, dst string"), {"v": 1}, e)
    hit = json.loads(kb.query("core concept", 1))["results"][0]
    assert hit["slug"] == "pages/alpha" and hit["score"] > 0.99 and "snippet" in hit
    assert json.loads(kb.answer("gamma"))["results"][0]["cites"] == ["pages/alpha"]
    assert "error" in json.loads(kb.query("  ")) and "error" in json.loads(kb.read("nope"))
    assert json.loads(kb.list_pages("page"))["total"] == 2 and json.loads(kb.provenance("chunks/top"))["teacher"] == "m"
    assert json.loads(kb.backlinks("pages/alpha"))["backlinks"] == ["pages/beta"] and json.loads(kb.neighborhood("pages/alpha", 1))["levels"] == {"1": ["pages/beta"]}
    assert kb.read_resource("wiki://pages/alpha").startswith("# Alpha") and json.loads(kb.read_resource("wiki://manifest")) == {"v": 1} and kb.resources().count() == 3
    assert json.loads(kb.call("read_wiki_page", slug="pages/alpha"))["title"] == "Alpha" and "error" in json.loads(kb.call("nope")) and "error" in json.loads(kb.call("get_thesis"))
    kb.thesis = {"summary": "s"}
    assert json.loads(kb.read_resource("wiki://thesis")) == {"summary": "s"} and all(r["kind"] == "page" for r in json.loads(kb.query_pages("alpha"))["results"])
    assert set(PROMPTS) == {"summarize_wiki", "ask_about", "compare_topics"} and "get_thesis" in prompt("summarize_wiki")
    assert "x y?" in prompt("ask_about", question=" x y? ") and "aa" in (both := prompt("compare_topics", topic_a="aa", topic_b="bb")) and "bb" in both
    for bad in (("ask_about", {}), ("compare_topics", {"topic_a": "aa", "topic_b": " "}), ("nope", {})):
        with pytest.raises(ValueError):
            prompt(bad[0], **bad[1])


def test_medians_of_large_and_small_namespaces(spark):
    """Exact upper medians, with many distinct scores, ties, halves without a score, and none."""
    import random

    r = random.Random(6)
    scores = {"hot": [r.random() * 100 for _ in range(60_001)], "even": [r.random() for _ in range(30_000)], "tied": [5.0] * 900 + [7.0] * 900, "two": [1.0, 2.0], "one": [3.0], "none": [None] * 4, "half": [None, 4.0, 9.0], None: [8.0, -1.0, 0.5]}
    rows = [(n, x, x is not None and x > 3) for n, xs in scores.items() for x in xs]
    df = spark.createDataFrame(rows, "namespace string, quality_score double, validator_passed boolean").repartition(6)
    got = {x.namespace: (x.total, x.scored, x.median) for x in St.audit(df).collect()}
    known = {n: sorted(x for x in xs if x is not None) for n, xs in scores.items()}
    assert got == {n: (len(scores[n]), len(k), k[len(k) // 2] if k else None) for n, k in known.items()}
