import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline as cp
from loomwork.llm import sentencepiece_bpe, toxicity
from tests.llm.helpers import edge_rows
from tests.llm.test_jaccard_join import brute as components_of
from tests.llm.test_others import brute_mix

#: With columns of names that stages might use themselves.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "row", "_row", "spans", "words", "component", "__lw_row"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in COLUMNS[5:])


def planted():
    """Clean rows, rows with an insult, near copies, and rows that share a passage of 51 to 60 words."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["an", "er", "th", "in", "or", "st"]) for _ in range(rng.randint(2, 4)))
    passages = [" ".join(word() for _ in range(rng.randint(51, 60))) for _ in range(6)]
    rows, shared = [], {}
    for i in range(100, 260):
        w = [word() for _ in range(rng.randint(3, 120))]
        if i % 5 == 0:
            w[rng.randrange(len(w))] = "scumbag"
        if i % 9 == 0 and i > 120:
            w = rows[-7][1].split()
        elif i % 4 == 1:
            w += [word() for _ in range(40)]
            shared[i] = passages[i % 6]
            k = rng.randrange(len(w))
            w[k:k] = shared[i].split()
        rows.append((i, " ".join(w), "en", rng.choice("abc"), 1))
    return rows, shared


def tables(spark, folder):
    rows, _ = planted()
    more = tuple("x" for _ in COLUMNS[5:])
    docs = spark.createDataFrame([r + more for r in edge_rows() + rows], SCHEMA)
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(r[0], 1, int("scumbag" in r[1].split())) for r in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def without_repeats(texts, length):
    """Texts without what stands in ``length`` bytes that start elsewhere too; whole characters, judged on the input."""
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for b in raw:
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]] = seen.get(b[s : s + length], 0) + 1
    out = []
    for t, b in zip(texts, raw):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = True
        starts = [k for k, c in enumerate(b) if c & 0xC0 != 0x80] + [len(b)]
        left = "".join(b[x:y].decode() for x, y in zip(starts, starts[1:]) if not gone[x:y].all())
        out.append(left if gone.any() else t)
    return out


def rows_of(df):
    return sorted((str(r.doc_id), str(r.text)) for r in df.collect())


def expected(stage, docs, scores):
    """(doc_id, text, source) of what a stage keeps, by brute force."""
    if stage == "toxicity":
        return [r for r in docs if scores[r[1] or ""] < toxicity.THRESHOLD]
    if stage == "n-gram Jaccard join":
        groups = components_of([(i, t) for i, t, _ in docs])
        least = {c for _, n, c in groups if n}
        kept, seen = [], set()
        for r in docs:
            if not (r[1] or "").split():
                kept.append(r)
            elif str(r[0]) in least and r[0] not in seen:
                seen.add(r[0])
                kept.append(r)
        return kept
    if stage == "suffix-array dedup":
        left = without_repeats([t for _, t, _ in docs], cp.REPEAT_BYTES)
        return [(i, new, s) for (i, t, s), new in zip(docs, left) if new or not t]
    copies, _ = brute_mix(docs)
    cut = lambda t, n: t if n == len(t.split()) else " ".join(t.split()[:n])
    return [(docs[k][0], cut(docs[k][1], n), docs[k][2]) for k, n in copies]


def test_every_stage_and_the_run_match_brute_force(spark, tmp_path):
    d = str(tmp_path / "in")
    docs = tables(spark, d)
    model = toxicity.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    text_of = {(str(r.doc_id), r.n_chars): r.text for r in docs.collect()}
    assert text_of
    scored = toxicity.score(docs.dropDuplicates(["text"]).selectExpr("monotonically_increasing_id() as doc_id", "text"), model)
    by_id = {r.doc_id: r.text or "" for r in docs.dropDuplicates(["text"]).selectExpr("monotonically_increasing_id() as doc_id", "text").collect()}
    scores = {by_id[r.doc_id]: r.score for r in scored.collect()}
    before, want = docs, [(r.doc_id, r.text, r.source) for r in docs.collect()]
    for k, (name, stage) in enumerate(cp.STAGES[:-1]):
        path = str(tmp_path / str(k))
        stage(spark, before, d).write.parquet(path)
        before = spark.read.parquet(path)
        assert before.columns == COLUMNS
        # each stage is judged on what it was given
        want = expected(name, want, scores)
        assert rows_of(before) == sorted((str(i), str(t)) for i, t, _ in want), name
        want = [(r.doc_id, r.text, r.source) for r in before.collect()]
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_bpe.default_model())
    last = sorted((str(i), hashlib.sha256(",".join(map(str, lib.encode(t or ""))).encode()).hexdigest()) for i, t, _ in want)
    assert sorted((str(r.doc_id), r.ids_sha256) for r in cp.run(spark, d).collect()) == last


def test_planted_passages_go_and_clean_texts_stay(spark, tmp_path):
    rows, shared = planted()
    more = tuple("x" for _ in COLUMNS[5:])
    docs = spark.createDataFrame([r + more for r in rows], SCHEMA)
    kept = {r.doc_id: r.text for r in cp.drop_repeats(spark, docs, "").collect()}
    copies = {r[1] for r in rows if sum(x[1] == r[1] for x in rows) > 1}
    for i, text, *_ in rows:
        if i in shared:
            assert i not in kept or shared[i] not in kept[i]
            assert not any(shared[i].split()[k] + " " + " ".join(shared[i].split()[k + 1 : k + 40]) in kept.get(i, "") for k in range(5))
        elif text not in copies and not any(text in t for t in copies):
            assert kept[i] == text


@pytest.mark.parametrize("k", range(len(cp.STAGES)))
def test_empty_tables(spark, tmp_path, k):
    d = str(tmp_path / "in")
    docs = tables(spark, d).limit(0)
    assert cp.STAGES[k][1](spark, docs, d).count() == 0
