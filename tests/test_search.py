import math
import random
from bisect import bisect_right

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import context, global_search, index, search

SECTION = "section_id string, title string, content string, file_path string"


def sections(spark, rows):
    return spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], SECTION)


def sections_of(spark, path):
    from quillmark.plans import corpus

    return corpus.sections(spark, str(path))


@pytest.fixture(scope="module")
def built(spark):
    rows = [("Alpha guide", "alpha beta beta", "a.md"), ("Gamma", "gamma delta the end", None), ("Delta", "delta " * 200, "d.md"), ("Other", "words of no use", "o.md"), ("More", "still other words", "m.md")]
    return index.build(sections(spark, rows))


def test_bm25_by_hand(built):
    found = {r.section_id: r.score for r in search.bm25(built, ["beta"]).collect()}
    lengths = [5, 5, 201, 5, 4]
    tf, df, n, dl, mean = 2, 1, 5, 5, sum(lengths) / 5
    want = math.log((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))
    assert found == {"0": pytest.approx(want)}
    twice = {r.section_id: r.score for r in search.bm25(built, ["beta", "beta"]).collect()}
    assert twice == {"0": pytest.approx(2 * want)}


def test_common_terms_score_nothing(spark):
    few = index.build(sections(spark, [("test", "test", "a"), ("test", "x", "b"), ("y", "z", "c")]))
    assert search.bm25(few, ["test"]).count() == 0
    assert search.bm25(few, []).count() == 0 and search.hybrid_search(few, "how is the").count() == 0


def test_batch_equals_single_queries(spark, built):
    asked = {"q1": ["beta"], "q2": ["gamma", "delta", "gamma"], "q3": ["absent"]}
    batch = search.bm25_batch(built, spark.createDataFrame(list(asked.items()), "query_id string, terms array<string>"))
    got = {(r.query_id, r.section_id): round(r.score, 9) for r in batch.collect()}
    assert got == {(q, r.section_id): round(r.score, 9) for q, terms in asked.items() for r in search.bm25(built, terms).collect()}


def test_index_round_trip(spark, built, tmp_path):
    index.write(built, f"{tmp_path}/i", 4)
    again = index.load(spark, f"{tmp_path}/i")
    plan = search.search(again, "beta gamma", "keyword")
    assert sorted(map(repr, plan.collect())) == sorted(map(repr, search.search(built, "beta gamma", "keyword").collect())) and plan.count() == 2
    text = plan._jdf.queryExecution().toString()
    assert "dynamicpruning" in text and "PushedFilters: [In(term" in text and "postings" not in text
    both = [sorted((r.section_id, round(r.score, 9)) for r in search.bm25(i, ["beta", "gamma", "beta"]).collect()) for i in (again, built)]
    assert both[0] == both[1]


def test_similarity_blocks_and_odd_vectors(spark, monkeypatch):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", None), ("d", [1.0]), ("e", [])], "section_id string, embedding array<float>").repartition(2)
    queries = [("x", [1.0, 0.0]), ("y", [0.0, 1.0]), ("z", [-1.0, 0.0])]
    want = {("x", "a"), ("x", "b"), ("y", "b")}
    for block in (1024, 1):
        monkeypatch.setattr(search, "QUERY_BLOCK", block)
        assert {(r.query_id, r.section_id) for r in search.similar(vectors, queries).collect()} == want
    assert search.similar(vectors, []).count() == 0


def test_whole_dense_batch_equals_brute_force(spark, tmp_path, monkeypatch):
    from quillmark.plans import catalogue

    vectors = {i: [math.cos(i), math.sin(i)] for i in [*range(130), 200, 1000, 1001, 5000]}
    spark.createDataFrame([(i, v, 0) for i, v in vectors.items()], "vec_id bigint, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    import numpy as np

    real = {i: np.array(v, np.float32).astype(float) for i, v in vectors.items()}
    want = {}
    for q in (0, 50, 100, 200, 1000, 5000):
        ranked = sorted((-round(float(real[q] @ real[i]), 6), str(i)) for i in vectors)
        want[str(q)] = [(i, -s) for s, i in ranked if -s > -1][:10]
    for block in (1024, 4, 1):
        monkeypatch.setattr(search, "QUERY_BLOCK", block)
        rows = catalogue.QUERIES["semantic_batch"](spark, str(tmp_path)).collect()
        got = {}
        for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
            got.setdefault(r.query_id, []).append((r.section_id, pytest.approx(r.score, abs=2e-6)))
        assert got == want


def test_nearest_keeps_ties_and_few(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(f"v{i}", [float(rnd.randint(0, 2)), float(rnd.randint(0, 2))]) for i in range(5000)] + [("none", None), ("short", [1.0])]
    vectors = spark.createDataFrame(rows, "section_id string, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, -1.0]), ("c", None)], "query_id string, embedding array<double>")
    got = search.nearest(vectors, asked, str(tmp_path), 7, 0.5).collect()
    want = [i for _, i in sorted((-v[0], i) for i, v in rows if v and len(v) == 2)][:7]
    assert [r.section_id for r in sorted(got, key=lambda r: r["rank"])] == want and {r.query_id for r in got} == {"a"}
    assert search.nearest(vectors, asked.limit(0), str(tmp_path)).count() == 0


def test_whole_batch_queries_use_terms_after_the_third(spark, tmp_path):
    from quillmark.plans import catalogue

    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(["alpha beta gamma", "delta omega", "omega omega", *(f"filler{i} text{i}" for i in range(7))])]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "alpha beta gamma delta omega"), (2, "none such words omega")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = catalogue.QUERIES["bm25_batch_queries"](spark, str(tmp_path)).collect()
    assert {(r.query_id, r.section_id) for r in rows} == {(1, "0"), (1, "1"), (1, "2"), (2, "1"), (2, "2")}
    one = {r.section_id: round(r.score, 6) for r in search.bm25(index.build(sections_of(spark, tmp_path)), "alpha beta gamma delta omega".split()).collect()}
    assert {r.section_id: r.score for r in rows if r.query_id == 1} == one


def test_merge_and_boosts(spark):
    kind = "section_id string, title string, chars int, file_path string, score double, match_type string"
    row = lambda i, s, m, chars=600: (i, "Title", chars, "f", s, m)
    keyword = spark.createDataFrame([row("both", 1.0, "keyword"), row("kw", 2.0, "keyword")], kind)
    semantic = spark.createDataFrame([row("both", 0.5, "semantic"), row("sem", 0.4, "semantic", 5)], kind)
    rows = {r.section_id: r for r in search.merged(keyword, semantic).collect()}
    assert {k: (r.score, r.match_type) for k, r in rows.items()} == {"both": (1.25, "hybrid"), "kw": (4.0, "keyword"), "sem": (0.4, "semantic")}
    up = {r.section_id: r.score for r in search.boosted(search.merged(keyword, semantic), ["title"]).collect()}
    assert up["kw"] == pytest.approx(6.0) and up["sem"] == pytest.approx(0.4 * 1.5 * 1.2)


FACT = "section_id string, workspace_id string, workspace_name string, title string, content_preview string, file_path string, section_type string, keywords array<string>"


def facts(spark, **changes):
    base = {"section_id": "1", "workspace_id": "w", "workspace_name": "none", "title": "x", "content_preview": "y", "file_path": "p/q.txt", "section_type": "document", "keywords": []}
    return spark.createDataFrame([tuple((base | changes).values())], FACT)


def score(spark, query, **changes):
    r = global_search.scored(facts(spark, **changes), query).first()
    return r and r.score


def test_global_scores(spark):
    assert score(spark, "term", keywords=["term"]) is None
    assert score(spark, "term", title="Term") == 15 + 5 + 3
    assert score(spark, "term", title="terms of") == 12 + 5 + 3
    assert score(spark, "term", title="a term b", content_preview="term") == 8 + 2 + 10
    assert score(spark, "term", content_preview="term " * 9) == 6 + 5 + 3
    assert score(spark, "term", file_path="term/x.md", section_type="code") == 1.5 + 5 + 3 + 1
    assert score(spark, "term", file_path="x/term.md", section_type="documentation") == 3 + 5 + 3 + 0.5
    assert score(spark, "term", workspace_name="my-term", keywords=["Terms", "term"]) == 2 + 3 + 5 + 5 + 3
    assert score(spark, "ab of", title="ab") is None
    assert score(spark, "aaa bbb", content_preview="aaa" + "x" * 47 + "bbb") == 2 + 2 + 5 + 3 + (2 - 50 / 50)
    assert score(spark, "aaa ccc", content_preview="aaa only") == 2 + 2.5


def test_type_filter_comes_after_the_limit(spark):
    rows = [(str(i), "w", "n", "term", "", f"f{i}.{'py' if i > 1 else 'md'}", "document", []) for i in range(4)]
    df = spark.createDataFrame(rows, FACT)
    assert [r.section_id for r in global_search.search(df, "term", 2, "docs").collect()] == ["0", "1"]
    assert global_search.search(df, "term", 2, "code").count() == 0


def results(spark, sizes):
    return spark.createDataFrame([(f"{i}", f"t{i}", "x" * (4 * n), "unknown" if i else "f", i + 1) for i, n in enumerate(sizes)], "section_id string, title string, content string, file_path string, rank bigint")


@pytest.mark.parametrize(("sizes", "budget", "kept"), [([10, 20, 30], 60, [10, 20, 30]), ([10, 20, 200, 1], 131, [10, 20, "101"]), ([10, 20, 200, 1], 130, [10, 20]), ([500], 400, ["400"]), ([500, 1], 100, []), ([], 5, [])])
def test_budget(spark, sizes, budget, kept):
    rows = context.within_budget(results(spark, sizes), budget).orderBy("rank").collect()
    assert [f"{(len(r.body) - 3) // 4}" if r.truncated else len(r.body) // 4 for r in rows] == kept
    assert all(r.body.endswith("...") for r in rows if r.truncated)


def test_contexts(spark):
    budgeted = context.within_budget(results(spark, [1, 1]))
    assert context.engine_context(budgeted).first()[0] == "## t0\nxxxx\n\n## t1\nxxxx"
    assert context.text_response(budgeted).first()[0] == "## t0\n\nxxxx\n\n*Source: f*\n\n---\n\n## t1\n\nxxxx"
    assert context.engine_context(budgeted.limit(0)).first()[0] == context.NOTHING
    ranked = budgeted.withColumn("score", F.lit(0.12345)).withColumn("match_type", F.lit("keyword"))
    assert "**Relevance Score:** 0.123" in context.structured_response(ranked).first()[0]
    assert context.json_response(ranked).first()[0].startswith('[{"section_id":"0","title":"t0"')


@pytest.mark.parametrize("blocks", [False, True])
@pytest.mark.parametrize("budget", [5, 40, 10_000])
def test_packing_keeps_every_section_once(spark, budget, blocks):
    sizes = [3, 30, 1, 1, 90, 4, 4, 4, 0, 12]
    rows = [(g, i, f"{g}{i}", "t", "x" * (4 * n)) for g in "ab" for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "grp string, ord int, section_id string, title string, content string").repartition(3)
    chunks = context.packed_chunks(df, budget, blocks).orderBy("grp", "chunk_no").collect()
    assert [s for c in chunks for s in c.section_ids] == [r[2] for r in rows]
    assert all(c.token_count <= budget or c.section_count == 1 for c in chunks)
    assert [c.chunk_no for c in chunks if c.grp == "a"] == list(range(sum(c.grp == "a" for c in chunks)))


@pytest.mark.parametrize("budget", [0, 7, 60, 1000])
def test_blocks_pack_as_one_task_does(spark, budget):
    """One group holds most rows; some sections have no tokens, some are over the budget, and a null group and null contents are among them."""
    rng = random.Random(budget)
    sizes = lambda n: [rng.choice([0, 0, 1, 3, 8, 30, 90]) for _ in range(n)]
    rows = [(g, i, f"{i}", "t", None if s == 90 and i % 2 else "x" * (4 * s)) for g, n in (("hot", 700), ("a", 3), ("b", 90), (None, 5)) for i, s in enumerate(sizes(n))]
    df = spark.createDataFrame(rows, "grp string, ord int, section_id string, title string, content string").repartition(5)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that one group lies in several blocks
    try:
        apart = context.packed_chunks(df, budget, True).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    key = lambda r: (r.grp or "", r.chunk_no)
    assert sorted(apart, key=key) == sorted(context.packed_chunks(df, budget, False).collect(), key=key)
    assert sum(r.section_count for r in apart) == len(rows)
    assert not context.packed_chunks(df.limit(0), budget, True).collect()


def test_steps_of_a_run_equal_packing_it():
    rng = random.Random(3)
    for _ in range(300):
        tokens, budget, used = [rng.choice([0, 1, 2, 5, 20]) for _ in range(rng.randint(1, 12))], rng.randint(0, 12), rng.randint(0, 25)
        ends, left, begun, total = context.packing_steps(np.array(tokens), budget)
        at = bisect_right(ends, budget - used)
        got = (left[at], begun[at] + 1) if at < len(ends) else (used + total, 0)
        number = 0
        for t in tokens:
            used, number = (used + t, number) if used + t <= budget else (t, number + 1)
        assert got == (used, number) and len(ends) <= budget + 2


def test_sentence_chunks_overlap():
    assert context.sentence_chunks_of(["a" * 300, "b" * 40, "c" * 300, "d" * 600, "e"]) == ["a" * 300 + " " + "b" * 40, "b" * 40 + " " + "c" * 300, "d" * 600, "e"]
    assert context.sentence_chunks_of([]) == []
