"""Queries over the inverted index, dense vectors, their merge, contexts and the cross-workspace table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions import constants as K
from quillmark.functions import text as T
from quillmark.operators import context, global_search, index, search
from quillmark.plans import corpus as C
from quillmark.plans.registered import query

TERMS = ["worthless", "oran", "license", "the", "anat"]
QUERY = "The worthless, oran anat error?"


def values(terms: list[str], query_id: str = "''") -> str:
    return "SELECT " + query_id + " AS query_id, unnest([" + ", ".join(f"'{t}'" for t in terms) + "]) AS term"


@query("tokenize_counts", f"WITH {C.INDEX} SELECT section_id, term, tf FROM postings")
def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    return index.build(C.sections(spark, d)).postings


@query("document_frequency", f"WITH {C.INDEX} SELECT term, df FROM term_stats")
def document_frequency(spark, d):
    return index.build(C.sections(spark, d)).term_stats


@query("section_lengths", f"WITH {C.INDEX} SELECT section_id, dl FROM section_stats")
def section_lengths(spark, d):
    return index.build(C.sections(spark, d)).section_stats.select("section_id", "dl")


@query("corpus_stats", f"WITH {C.INDEX} SELECT n, round(avg_dl, 6) AS avg_dl FROM corpus_stats")
def corpus_stats(spark, d):
    return index.build(C.sections(spark, d)).corpus_stats.withColumn("avg_dl", F.round("avg_dl", 6))


@query("postings_for_terms", f"WITH {C.INDEX} SELECT term, section_id, tf FROM postings WHERE term IN ('worthless', 'oran', 'license', 'the', 'anat')")
def postings_for_terms(spark, d):
    return index.build(C.sections(spark, d)).postings.filter(F.col("term").isin(TERMS))


def scores(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query("bm25_topk", f"WITH {C.INDEX}{C.bm25_sql(values(TERMS))} SELECT section_id, round(score, 6) AS score FROM bm25 ORDER BY round(score, 6) DESC, section_id LIMIT 50")
def bm25_topk(spark, d):
    return scores(search.best(search.bm25(index.build(C.sections(spark, d)), TERMS), 50))


DUPLICATED = "oran worthless oran"


@query("bm25_keyword_dup_terms", f"WITH {C.INDEX}{C.bm25_sql(values(DUPLICATED.split()))} SELECT section_id, title, file_path, round(score, 6) AS score, 'keyword' AS match_type FROM bm25 JOIN sections USING (section_id) ORDER BY round(score, 6) DESC, section_id LIMIT 50")
def bm25_keyword_dup_terms(spark, d):
    return scores(search.search(index.build(C.sections(spark, d)), DUPLICATED, "keyword")).drop("content")


PREPROCESSED = rf"list_filter({C.WORDS.format('text')}, lambda w: length(w) > 2 AND w NOT IN ({', '.join(f"'{w}'" for w in K.QUERY_STOP_WORDS)}))"


@query(
    "bm25_batch_queries",
    f"WITH {C.INDEX}{C.bm25_sql(f'SELECT item_id AS query_id, unnest({PREPROCESSED}) AS term FROM benchmark')}, "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, section_id) AS rank FROM bm25) SELECT query_id, section_id, round(score, 6) AS score, rank FROM r WHERE rank <= 5",
)
def bm25_batch_queries(spark, d):
    """The top 5 of each benchmark item by all of its terms."""
    asked = C.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), T.query_terms("text").alias("terms"))
    found = scores(search.bm25_batch(index.build(C.sections(spark, d)), asked))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "section_id")).cast("bigint")
    return found.withColumn("rank", rank).filter("rank <= 5")


@query("query_preprocess", f"SELECT item_id, {PREPROCESSED} AS terms FROM benchmark")
def query_preprocess(spark, d):
    return C.table(spark, d, "benchmark").select("item_id", T.query_terms("text").alias("terms"))


ASKED = ["How to install the API", "run test RUN", "what is", "error in config!", "Straße naïve x² the doc", "widget retrieval get_it", "please show me how does the function work", "setup database configuration", "json settings guide", "a b c", "find authentication class; implement"]
ASKED_SQL = "asked AS (SELECT unnest([" + ", ".join("'" + a + "'" for a in ASKED) + "]) AS q)"


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a,) for a in ASKED], "q string")


SYNONYM_ROWS = ", ".join(f"('{k}', '{s}')" for k, v in K.SYNONYMS.items() for s in v)
TERMS_OF_Q = PREPROCESSED.replace("lower(text)", "lower(q)")


@query(
    "query_expand",
    f"""WITH {ASKED_SQL}, t AS (SELECT q, unnest({TERMS_OF_Q}) AS term FROM asked), s(term, other) AS (VALUES {SYNONYM_ROWS}),
    e AS (SELECT q, term FROM t UNION SELECT q, other FROM t JOIN s USING (term))
    SELECT q, coalesce(list_sort(list(term) FILTER (term IS NOT NULL)), []) AS terms FROM asked LEFT JOIN e USING (q) GROUP BY q""",
)
def query_expand(spark, d):
    return asked(spark).select("q", F.sort_array(T.expanded(T.query_terms("q"))).alias("terms"))


def _cleaned_sql() -> str:
    out = "lower(q)"
    for p in K.CLEANER_STOP_PHRASES:
        out = f"replace({out}, '{p}', ' ')"
    kept = f"list_filter(string_split_regex({out}, '{C.SPACE}+'), lambda w: length(w) > 2 AND w NOT IN ({', '.join(f"'{w}'" for w in K.CLEANER_STOP_WORDS)}))"
    return f"CASE WHEN len({kept}) > 0 THEN array_to_string({kept}, ' ') ELSE q END"


@query("clean_query", f"WITH {ASKED_SQL} SELECT q, {_cleaned_sql()} AS cleaned FROM asked")
def clean_query(spark, d):
    return asked(spark).select("q", T.cleaned_query("q").alias("cleaned"))


HINT_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in K.KEYWORD_HINTS.items())


@query(
    "suggest_keywords",
    f"""WITH {ASKED_SQL}, h(w, hint) AS (VALUES {HINT_ROWS}), w AS (SELECT q, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT q, string_split_regex(lower(q), '{C.SPACE}+') AS ws FROM asked)),
    r AS (SELECT q, coalesce(hint, w) AS s, row_number() OVER (PARTITION BY q ORDER BY i) AS r FROM w LEFT JOIN h USING (w) WHERE hint IS NOT NULL OR length(w) > 3)
    SELECT q, coalesce(string_agg(s, ' ' ORDER BY r) FILTER (r <= 3), '{K.DEFAULT_HINT}') AS suggestion FROM asked LEFT JOIN r USING (q) GROUP BY q""",
)
def suggest_keywords(spark, d):
    return asked(spark).select("q", T.suggested_keywords("q").alias("suggestion"))


@query("suggest_type", f"WITH {ASKED_SQL} SELECT q, CASE " + " ".join(f"WHEN regexp_matches(lower(q), '{'|'.join(v)}') THEN '{k}'" for k, v in K.TYPE_HINTS.items()) + " ELSE 'all' END AS kind FROM asked")
def suggest_type(spark, d):
    return asked(spark).select("q", T.suggested_type("q").alias("kind"))


BASIC = "worthless oran of the anat"
BASIC_TERMS = [t for t in BASIC.split() if t not in K.BASIC_STOP_WORDS and len(t) > 2]


@query(
    "basic_search",
    f"""WITH {C.SECTIONS}, s AS (SELECT *, least(1.0::DOUBLE, ({" + ".join(f"(length(low) - length(replace(low, '{t}', ''))) // {len(t)}" for t in BASIC_TERMS)}) * 0.1::DOUBLE) AS score FROM (SELECT *, lower(title || ' ' || content) AS low FROM sections))
    SELECT section_id, substr(content, 1, 200) || '...' AS content, file_path, 1 AS line_number, round(score, 6) AS score, 'basic' AS match_type FROM s WHERE score > 0 ORDER BY round(score, 6) DESC, section_id LIMIT 10""",
)
def basic_search(spark, d):
    return scores(search.basic_search(C.sections(spark, d), BASIC))


VECTORS = "v AS (SELECT vec_id::VARCHAR AS section_id, vec_id, embedding::DOUBLE[] AS e FROM embeddings)"


def query_vectors(spark: SparkSession, d: str, below: int) -> list[tuple[str, list[float]]]:
    """The vectors whose id is below a small number, as queries."""
    rows = C.table(spark, d, "embeddings").filter(F.col("vec_id") < below).select("vec_id", "embedding").orderBy("vec_id").collect()
    return [(str(r.vec_id), list(r.embedding)) for r in rows]


@query("semantic_topk", f"WITH {VECTORS} SELECT v.section_id, round(list_dot_product(v.e, q.e), 6) AS score FROM v, v q WHERE q.vec_id = 0 AND list_dot_product(v.e, q.e) > -1 ORDER BY score DESC, section_id LIMIT 50")
def semantic_topk(spark, d):
    found = search.similar(C.vectors(spark, d), query_vectors(spark, d, 1), -1.0).select("section_id", "score")
    return scores(search.best(found, 50))


@query("semantic_threshold", f"WITH {VECTORS} SELECT v.section_id, round(list_dot_product(v.e, q.e), 6) AS score FROM v, v q WHERE q.vec_id = 0 AND list_dot_product(v.e, q.e) > 0.1")
def semantic_threshold(spark, d):
    return scores(search.similar(C.vectors(spark, d), query_vectors(spark, d, 1), 0.1).select("section_id", "score"))


NEAREST = 10


@query(
    "semantic_batch",
    f"""WITH {VECTORS}, s AS (SELECT q.section_id AS query_id, v.section_id, round(list_dot_product(v.e, q.e), 6) AS score FROM v, v q WHERE q.vec_id % 50 = 0 AND list_dot_product(v.e, q.e) > -1),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, section_id) AS rank FROM s) SELECT * FROM r WHERE rank <= {NEAREST}""",
)
def semantic_batch(spark, d):
    """The nearest vectors of every vector whose id is divisible by 50."""
    asked = C.table(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("query_id"), "embedding")
    return scores(search.nearest(C.vectors(spark, d), asked, C.shared_folder(spark), NEAREST, -1.0))


LEAST = 0.1
LEGS = f"""{C.INDEX}{C.bm25_sql(values(["worthless", "oran", "anat", "error", "exception", "bug", "issue", "problem"]))}, {VECTORS},
k AS (SELECT section_id, 2.0::DOUBLE * score AS ks FROM bm25), m AS (SELECT v.section_id, list_dot_product(v.e, q.e) AS ss FROM v JOIN sections USING (section_id), v q WHERE q.vec_id = 0 AND list_dot_product(v.e, q.e) > {LEAST}),
merged AS (SELECT section_id, CASE WHEN ks IS NOT NULL AND ss IS NOT NULL THEN (ks + ss) / 2 ELSE coalesce(ks, ss) END AS score,
    CASE WHEN ks IS NOT NULL AND ss IS NOT NULL THEN 'hybrid' WHEN ks IS NOT NULL THEN 'keyword' ELSE 'semantic' END AS match_type FROM k FULL OUTER JOIN m USING (section_id)),
boosted AS (SELECT section_id, title, content, file_path, match_type, score * CASE WHEN regexp_matches(lower(title), 'worthless|oran|anat|error') THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END
    * CASE WHEN length(content) < 500 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END AS score FROM merged JOIN sections USING (section_id)),
ranked AS (SELECT *, row_number() OVER (ORDER BY round(score, 6) DESC, section_id) AS rank FROM boosted)"""


def legs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    built = index.build(C.sections(spark, d))
    return search.keyword_search(built, search.expand(search.terms_of(QUERY))), search.semantic_search(built, C.vectors(spark, d), query_vectors(spark, d, 1)[0][1], LEAST)


def hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Ranked results of the whole hybrid query, at a similarity threshold that some vectors pass."""
    built = index.build(C.sections(spark, d))
    return context.ranked(search.hybrid_search(built, QUERY, C.vectors(spark, d), query_vectors(spark, d, 1)[0][1], threshold=LEAST))


@query("hybrid_merge", f"WITH {LEGS} SELECT section_id, title, file_path, match_type, round(merged.score, 6) AS score FROM merged JOIN sections USING (section_id)")
def hybrid_merge(spark, d):
    return scores(search.merged(*legs(spark, d))).drop("chars")


@query("hybrid_search", f"WITH {LEGS} SELECT section_id, title, content, file_path, match_type, round(score, 6) AS score, rank FROM ranked WHERE rank <= 50")
def hybrid_search(spark, d):
    return scores(hybrid(spark, d))


@query(
    "search_mode_counts",
    f"""WITH {C.INDEX}{C.bm25_sql(values(["worthless", "oran", "anat", "error"]))}, {VECTORS}, q AS (SELECT e FROM v WHERE vec_id = 0),
    s AS (SELECT count(*) AS n FROM v JOIN sections USING (section_id), q WHERE list_dot_product(v.e, q.e) > 0.3)
    SELECT 'keyword' AS mode, (SELECT least(count(*), 50) FROM bm25)::BIGINT AS results UNION ALL SELECT 'semantic', (SELECT least(n, 50) FROM s)::BIGINT
    UNION ALL SELECT 'hybrid', (SELECT least(count(*), 50) FROM (SELECT section_id FROM bm25 UNION SELECT v.section_id FROM v JOIN sections USING (section_id), q WHERE list_dot_product(v.e, q.e) > 0.3))::BIGINT""",
)
def search_mode_counts(spark, d):
    built, vectors, q = index.build(C.sections(spark, d)), C.vectors(spark, d), query_vectors(spark, d, 1)[0][1]
    modes = [search.search(built, QUERY, m, vectors, q).agg(F.lit(m).alias("mode"), F.count(F.lit(1)).alias("results")) for m in ("keyword", "semantic", "hybrid")]
    return modes[0].unionByName(modes[1]).unionByName(modes[2])


def budget_sql(budget: int) -> str:
    return f"""r AS (SELECT *, (length(content) // 4)::BIGINT AS tokens FROM ranked WHERE rank <= 50), c AS (SELECT *, (sum(tokens) OVER (ORDER BY rank))::BIGINT AS total FROM r),
    f AS (SELECT *, total > {budget} AS truncated, {budget} - (total - tokens) AS room, count(*) FILTER (total > {budget}) OVER (ORDER BY rank) AS nth FROM c),
    b AS (SELECT rank, section_id, title, file_path, tokens, truncated, CASE WHEN truncated THEN substr(content, 1, (room * 4)::BIGINT) || '...' ELSE content END AS body FROM f WHERE NOT truncated OR (nth = 1 AND room > 100))"""


@query("context_budget", f"WITH {LEGS}, {budget_sql(4000)} SELECT coalesce(string_agg('## ' || title || chr(10) || body, chr(10) || chr(10) ORDER BY rank), 'No relevant content found.') AS context FROM b")
def context_budget(spark, d):
    return context.engine_context(context.within_budget(hybrid(spark, d)))


@query("context_truncated_row", f"WITH {LEGS}, {budget_sql(900)} SELECT rank, section_id, tokens, truncated, length(body) AS chars FROM b")
def context_truncated_row(spark, d):
    return context.within_budget(hybrid(spark, d), 900).select("rank", "section_id", "tokens", "truncated", F.length("body").cast("bigint").alias("chars"))


@query("text_response", f"WITH {LEGS}, {budget_sql(4000)} SELECT string_agg('## ' || title || chr(10) || chr(10) || body || chr(10) || chr(10) || '*Source: ' || file_path || '*', chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS content FROM b")
def text_response(spark, d):
    return context.text_response(context.within_budget(hybrid(spark, d)))


@query(
    "structured_results",
    f"WITH {LEGS} SELECT rank, '### Result ' || rank || ': ' || title || chr(10) || '**Relevance Score:** ' || printf('%.3f', round(score, 6)) || chr(10) || '**Match Type:** ' || match_type || chr(10) || '**Source:** ' || file_path || chr(10) || chr(10) || content || chr(10) AS block FROM ranked WHERE rank <= 50",
)
def structured_results(spark, d):
    return context.structured_blocks(scores(hybrid(spark, d)))


def pack_sql(source: str, budget: int) -> str:
    """Greedy packing by recursion over source(grp, i, section_id, title, content), i from 1 on."""
    return f"""WITH RECURSIVE {source}, z AS (SELECT *, (length(content) // 4)::BIGINT AS tokens FROM src),
    f(grp, i, chunk_no, used) AS (SELECT grp, i, 0::BIGINT, tokens FROM z WHERE i = 1
        UNION ALL SELECT z.grp, z.i, CASE WHEN used + tokens <= {budget} THEN chunk_no ELSE chunk_no + 1 END, CASE WHEN used + tokens <= {budget} THEN used + tokens ELSE tokens END FROM f JOIN z ON z.grp = f.grp AND z.i = f.i + 1)
    SELECT grp, chunk_no, list(section_id ORDER BY i) AS section_ids, md5(string_agg('# ' || title || chr(10) || content, chr(10) || chr(10) ORDER BY i)) AS content_md5, sum(tokens)::BIGINT AS token_count, count(*)::BIGINT AS section_count
    FROM f JOIN z USING (grp, i) GROUP BY grp, chunk_no"""


BY_SOURCE = f"{C.SECTIONS}, src AS (SELECT workspace_id AS grp, row_number() OVER (PARTITION BY workspace_id ORDER BY doc_id) AS i, section_id, title, content FROM sections)"


def _packed(budget: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = C.sections(spark, d).withColumnsRenamed({"workspace_id": "grp", "doc_id": "ord"})
        return context.packed_chunks(rows, budget).withColumn("content", F.md5("content")).withColumnRenamed("content", "content_md5")

    return run


for _budget in K.CHUNK_BUDGETS:
    query(f"pack_chunks_{_budget}", pack_sql(BY_SOURCE, _budget))(_packed(_budget))


@query("pack_conversations", pack_sql("src AS (SELECT conv_id::VARCHAR AS grp, row_number() OVER (PARTITION BY conv_id ORDER BY turn, conv_id || ':' || turn) AS i, conv_id || ':' || turn AS section_id, role AS title, text AS content FROM conversations)", 200))
def pack_conversations(spark, d):
    rows = C.table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("grp"), F.col("turn").alias("ord"), F.concat_ws(":", "conv_id", "turn").alias("section_id"), F.col("role").alias("title"), F.col("text").alias("content"))
    return context.packed_chunks(rows, 200).withColumn("content", F.md5("content")).withColumnRenamed("content", "content_md5")


SENTENCES = f"list_filter([{C.strip_sql('x')} FOR x IN string_split_regex(text, '[.!?]+')], lambda s: s <> '')"


@query("sentence_split", f"SELECT doc_id, unnest(s) AS sentence, unnest(range(len(s))) AS n FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)")
def sentence_split(spark, d):
    return C.table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences("text")).alias("n", "sentence")).withColumn("n", F.col("n").cast("bigint"))


def _sum_of(x: str) -> str:
    return f"coalesce(list_sum([length(s) FOR s IN {x}]), 0)"


CHUNKS = f"""WITH RECURSIVE d AS (SELECT doc_id::VARCHAR AS section_id, {SENTENCES} AS ss FROM documents),
z AS (SELECT section_id, unnest(ss) AS s, unnest(range(1, len(ss) + 1)) AS i, len(ss) AS m FROM d),
tail AS (SELECT 1),
f(section_id, i, m, no, held, made) AS (SELECT section_id, i, m, 0::BIGINT, [s], NULL::VARCHAR FROM z WHERE i = 1
    UNION ALL SELECT z.section_id, z.i, z.m, CASE WHEN {_sum_of('held')} + length(z.s) > 512 THEN no + 1 ELSE no END,
        CASE WHEN {_sum_of('held')} + length(z.s) > 512 THEN list_concat([held[j] FOR j IN range(1, len(held) + 1) IF {_sum_of('held[j:]')} <= 50], [z.s]) ELSE list_append(held, z.s) END,
        CASE WHEN {_sum_of('held')} + length(z.s) > 512 THEN array_to_string(held, ' ') END
    FROM f JOIN z ON z.section_id = f.section_id AND z.i = f.i + 1)
SELECT section_id, section_id || '_chunk_' || (no - 1) AS chunk_id, made AS chunk FROM f WHERE made IS NOT NULL
UNION ALL SELECT section_id, section_id || '_chunk_' || no, array_to_string(held, ' ') FROM f WHERE i = m"""


@query("sentence_chunks", CHUNKS)
def sentence_chunks(spark, d):
    return context.sentence_chunks(C.table(spark, d, "documents").select(F.col("doc_id").alias("section_id"), "text"))


@query("chunk_md5_dups", "SELECT md5(text) AS digest, count(*)::BIGINT AS copies FROM documents GROUP BY 1 HAVING count(*) > 1")
def chunk_md5_dups(spark, d):
    return C.table(spark, d, "documents").groupBy(F.md5("text").alias("digest")).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


WORD_COUNT = f"len(list_filter(string_split_regex(content, '{C.SPACE}+'), lambda w: w <> ''))::BIGINT"


@query("section_summaries", f"WITH {C.SECTIONS} SELECT section_id, title, file_path, CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END AS content_preview, {WORD_COUNT} AS word_count FROM sections")
def section_summaries(spark, d):
    return index.summaries(C.sections(spark, d))


@query("keywords_top10", f"WITH {C.FACTS} SELECT section_id, keywords FROM keywords")
def keywords_top10(spark, d):
    return index.top_keywords(C.sections(spark, d))


GLOBAL = ["the", "and", "with", "that"]
PAIR = ["anat", "src1"]


@query("global_terms_scored", f"WITH {C.FACTS}{C.global_sql(['src1'])} SELECT section_id, points, hits::BIGINT AS hits FROM pointed")
def global_terms_scored(spark, d):
    points, hits = global_search.term_score("src1")
    return C.facts(spark, d).select("section_id", points.alias("points"), hits.cast("bigint").alias("hits"))


@query("global_search_topk", f"WITH {C.FACTS}{C.global_sql(PAIR)} SELECT section_id, workspace_id, title, section_type, keywords, round(score, 6) AS score FROM scored ORDER BY round(score, 6) DESC, section_id LIMIT 20")
def global_search_topk(spark, d):
    return scores(global_search.search(C.facts(spark, d), " ".join(PAIR))).select("section_id", "workspace_id", "title", "section_type", "keywords", "score")


@query("global_scored_all", f"WITH {C.FACTS}{C.global_sql(GLOBAL)} SELECT section_id, round(score, 6) AS score FROM scored")
def global_scored_all(spark, d):
    return scores(global_search.scored(C.facts(spark, d), " ".join(GLOBAL))).select("section_id", "score")


@query("global_proximity", f"WITH {C.FACTS}{C.global_sql(GLOBAL)} SELECT section_id, round(CASE WHEN len(places) > 1 THEN greatest(0.0::DOUBLE, 2.0::DOUBLE - (list_max(places) - list_min(places)) / (len(places) - 1) / 50.0::DOUBLE) ELSE 0.0::DOUBLE END, 6) AS proximity FROM pointed")
def global_proximity(spark, d):
    return C.facts(spark, d).select("section_id", F.round(global_search.proximity(GLOBAL), 6).alias("proximity"))


MIXED_SUFFIX = "[{}][doc_id % 5 + 1]".format(", ".join(f"'{s}'" for s in (".py", ".md", ".json", ".txt", ".bin")))


def _typed(kind: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        pick = F.array(*map(F.lit, (".py", ".md", ".json", ".txt", ".bin")))[(F.col("section_id").cast("bigint") % 5).cast("int")]
        rows = C.facts(spark, d).withColumn("file_path", F.concat(F.regexp_replace("file_path", r"\.md$", ""), pick))
        return scores(global_search.search(rows, " ".join(PAIR), 20, kind)).select("section_id", "file_path", "score")

    return run


for _kind, _ends in K.TYPE_SUFFIXES.items():
    query(
        f"global_search_{_kind}",
        f"""WITH {C.FACTS.replace("file_path, ['code'", f"regexp_replace(file_path, '[.]md$', '') || {MIXED_SUFFIX} AS file_path, ['code'")}{C.global_sql(PAIR)}, top AS (SELECT * FROM scored ORDER BY round(score, 6) DESC, section_id LIMIT 20)
        SELECT section_id, file_path, round(score, 6) AS score FROM top WHERE {C.SUFFIX_SQL.replace("(path", "(file_path")} IN ({", ".join(f"'{e}'" for e in _ends)})""".replace("split_part(path", "split_part(file_path"),
    )(_typed(_kind))


@query(
    "global_with_workspace",
    f"WITH {C.FACTS}{C.global_sql(PAIR)}, {C.WORKSPACES}, top AS (SELECT * FROM scored ORDER BY round(score, 6) DESC, section_id LIMIT 20) SELECT section_id, top.workspace_id, w.path AS workspace_path FROM top LEFT JOIN (SELECT * FROM workspaces WHERE status = 'active') w ON w.id = 'ws_' || top.workspace_id",
)
def global_with_workspace(spark, d):
    top = global_search.search(C.facts(spark, d), " ".join(PAIR)).withColumn("source", F.col("workspace_id")).withColumn("workspace_id", F.concat(F.lit("ws_"), "workspace_id"))
    return global_search.with_workspaces(top, C.workspaces(spark, d).filter("status = 'active'")).select("section_id", F.col("source").alias("workspace_id"), "workspace_path")
