from pyspark.sql import functions as F

from loomwork.operators import compile as Cp
from loomwork.operators.vectors import HashingEmbedder

ROWS = [{"category": "tactical_recipe", "query": "How to brew tea"}, {"category": "tactical_recipe", "query": "how to brew tea!"}, {"category": "nonsense", "query": "x"}, {"category": "explanatory", "query": " "}, {"category": "explanatory", "query": "What is a kettle"}]


def write(query, evidence):
    return f"On {query}", " ".join(["word"] * 60) + f" {len(evidence)}", [next(iter(evidence)), "nowhere"]


def pages(spark, edit=None):
    rows = [(f"p{i}", f"T{i}", f"{'tea' if i < 5 else 'kettle'} page number {i} [[p{(i + 1) % 12}]]" + ("!" if i == edit else ""), "page", i) for i in range(12)]
    df = spark.createDataFrame(rows, "slug string, title string, body string, kind string, page_ord long")
    return df.withColumn("content_full", F.concat("title", F.lit("\n\n"), "body"))


def test_full_then_changes(spark):
    e, thesis = HashingEmbedder(64), Cp.Thesis(target_audience="cooks", key_concepts=("b", "a"))
    assert thesis.hash == Cp.Thesis(target_audience="cooks", key_concepts=("a", "b"), summary="other").hash and len(thesis.hash) == 16
    full = Cp.compile_full(pages(spark), ROWS, write, e, thesis)
    chunks = full.chunks.collect()
    assert {c.archetype_id for c in chunks} == {"tactical_recipe--how-to-brew-tea", "explanatory--what-is-a-kettle"}
    assert all(len(c.cites) == 1 and c.cites[0] in c.evidence_slugs and 0 < c.quality_score <= 100 for c in chunks)
    assert full.edges.count() == 12 and full.vectors.count() == 14
    m = full.manifest("hash", 64, thesis)
    assert m["wiki"] == {"pages_count": 12, "chunks_count": 2, "crossref_edges": 12}
    same = Cp.compile_changes(full, pages(spark), write, e, thesis, "m", "m")
    assert same.mode == "incremental" and {c.slug for c in same.chunks.collect()} == {c.slug for c in chunks}
    hit = int(chunks[0].evidence_slugs[0][1:])
    edited = Cp.compile_changes(full, pages(spark, hit), write, e, thesis, "m", "m")
    assert edited.mode == "incremental" and edited.chunks.count() == 2 and edited.vectors.count() == 14
    assert Cp.compile_changes(full, pages(spark), write, e, thesis, "m", "other").mode == "full"
    assert Cp.valid_archetypes(ROWS)[0]["category"] == "tactical_recipe"
    used = Cp.generated_usage(full.chunks)
    assert used.calls == 2 and used.tokens_out >= 2 * 60
    counted = Cp.Usage()
    assert counted.counted(lambda prompt: prompt * 2)("abcdefgh") == "abcdefghabcdefgh" and (counted.calls, counted.tokens_in, counted.tokens_out) == (1, 2, 4)


def test_a_bundle_is_where_changes_start(spark):
    import json

    from loomwork.operators import incremental as I
    from loomwork.sources import corpus as Co

    e, thesis = HashingEmbedder(16), Cp.Thesis()
    full = Cp.compile_full(pages(spark), ROWS, write, e, thesis)
    state = I.state_of(full.state, full.archetypes, "m", 16, thesis.hash)
    assert I.State.from_json(state.to_json()) == state and json.loads(state.to_json())["counts"] == {"pages": 12, "chunks": 2}
    assert I.State.from_json('{"pages": null, "embedding": {"dims": null}}') == I.State()
    vectors = {r.slug: r.embedding for r in full.vectors.collect()}
    rows = [{"slug": r.slug, "title": r.title, "body": r.body, "kind": "page"} for r in full.pages.collect()]
    rows += [{"slug": r.slug, "title": r.title, "body": r.body, "kind": "chunk", "frontmatter": {"kind": "chunk", "archetype_id": r.archetype_id, "cites": json.dumps(r.cites)}} for r in full.chunks.collect()]
    manifest = full.manifest("m", 16, thesis)
    prior, told = Cp.prior_of_bundle(spark, Co.write_bundle(rows, vectors, manifest, json.loads(state.to_json())))
    assert told.model == "m" and prior.chunks.count() == 2 and prior.vectors.count() == 14 and prior.state["pages"].count() == 12
    assert {r.category for r in prior.chunks.collect()} == {"tactical_recipe", "explanatory"}
    same = Cp.compile_changes(prior, pages(spark), write, e, thesis, told.model, "m")
    assert same.mode == "incremental" and same.chunks.count() == 2
    assert Cp.prior_of_bundle(spark, Co.write_bundle(rows, vectors, manifest)) is None
