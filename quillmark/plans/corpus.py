"""Views of the driver's tables as the engine's inputs, in Spark and, under the same names, as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import constants as K
from quillmark.functions import text as T
from quillmark.operators import index
from quillmark.shared import planned_bytes, shared_folder

SPREAD_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores, where a scan of some megabytes has fewer tasks than cores, as one row group has; a larger table's scan is left as it is."""
    execution, cores = rows._jdf.queryExecution(), rows.sparkSession.sparkContext.defaultParallelism
    if planned_bytes(rows) < SPREAD_BYTES or execution.toRdd().getNumPartitions() >= cores:
        return rows
    return rows.repartition(cores)


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One section for each document: its first line is the title."""
    d = table(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string")
    return d.select(key.alias("section_id"), F.element_at(F.split("text", "\n"), 1).alias("title"), F.col("text").alias("content"), F.concat("source", F.lit("/"), "lang", F.lit("/"), key, F.lit(".md")).alias("file_path"), F.col("source").alias("workspace_id"), "doc_id")


SECTIONS = r"""
sections AS (SELECT doc_id::VARCHAR AS section_id, split_part(text, chr(10), 1) AS title, text AS content,
    source || '/' || lang || '/' || doc_id || '.md' AS file_path, source AS workspace_id, doc_id FROM documents)"""

#: Unicode words of lower-cased text, as in functions.text.
WORDS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}_]+'), lambda w: w <> '')"
SPACE = r"[\s\p{Z}\x1c-\x1f\x{85}]"


def strip_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SPACE}+', ''), '{SPACE}+$', '')"


INDEX = (
    SECTIONS
    + rf""",
tokens AS (SELECT section_id, {WORDS.format("title || ' ' || content")} AS tokens FROM sections),
postings AS (SELECT section_id, term, count(*)::BIGINT AS tf FROM (SELECT section_id, unnest(tokens) AS term FROM tokens) GROUP BY section_id, term),
term_stats AS (SELECT term, count(*)::BIGINT AS df FROM postings WHERE length(term) > 2 GROUP BY term),
section_stats AS (SELECT section_id, len(tokens)::BIGINT AS dl FROM tokens),
corpus_stats AS (SELECT count(*)::BIGINT AS n, avg(dl) AS avg_dl FROM section_stats)"""
)


def bm25_sql(query_terms: str) -> str:
    """A table bm25(query_id, section_id, score) over query_terms(query_id, term)."""
    return rf""",
query_terms AS ({query_terms}),
bm25 AS (SELECT query_id, section_id, sum(ln((n - df + 0.5) / (df + 0.5)) * (tf * ({K.BM25_K1} + 1.0)) / (tf + {K.BM25_K1} * (1 - {K.BM25_B} + {K.BM25_B} * dl / avg_dl))) AS score
    FROM postings JOIN query_terms USING (term) JOIN term_stats USING (term) JOIN section_stats USING (section_id), corpus_stats
    GROUP BY query_id, section_id HAVING score > 0)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flattened search table over the sections, of all three types."""
    s = sections(spark, sf_dir)
    kinds = F.array(F.lit("code"), F.lit("document"), F.lit("documentation"))
    rows = s.select("section_id", F.col("workspace_id"), F.col("workspace_id").alias("workspace_name"), "title", T.preview("content").alias("content_preview"), "file_path", kinds[(F.col("doc_id") % 3).cast("int")].alias("section_type"))
    return rows.join(index.top_keywords(s), "section_id")


FACTS = (
    SECTIONS
    + rf""",
keyword_words AS (SELECT section_id, w, i FROM (SELECT section_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT section_id, {WORDS.format("content")} AS ws FROM sections))
    WHERE regexp_full_match(w, '[a-z]{{3,}}') AND w NOT IN ({", ".join(f"'{w}'" for w in K.KEYWORD_STOP_WORDS)})),
keyword_ranks AS (SELECT section_id, w, row_number() OVER (PARTITION BY section_id ORDER BY count(*) DESC, min(i)) AS r FROM keyword_words GROUP BY section_id, w),
keywords AS (SELECT section_id, coalesce(list(w ORDER BY r) FILTER (r <= 10), []) AS keywords FROM sections LEFT JOIN keyword_ranks USING (section_id) GROUP BY section_id),
facts AS (SELECT section_id, workspace_id, workspace_id AS workspace_name, title, CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END AS content_preview,
    file_path, ['code', 'document', 'documentation'][doc_id % 3 + 1] AS section_type, keywords FROM sections JOIN keywords USING (section_id))"""
)


def global_sql(terms: list[str]) -> str:
    """A table scored(facts..., points, hits, score) for the terms."""
    points, hits, places = [], [], []
    for t in terms:
        title, body, path, name = "lower(title)", "lower(content_preview)", "lower(file_path)", "lower(workspace_name)"
        points.append(
            f"(CASE WHEN contains({title}, '{t}') THEN CASE WHEN {title} = '{t}' THEN 15 WHEN starts_with({title}, '{t}') OR ends_with({title}, '{t}') THEN 12 ELSE 8 END ELSE 0 END"
            f" + CASE WHEN contains({body}, '{t}') THEN least(2 * ((length({body}) - length(replace({body}, '{t}', ''))) // length('{t}')), 6) ELSE 0 END"
            f" + coalesce(list_sum([CASE WHEN lower(k) = '{t}' THEN 5 WHEN contains(lower(k), '{t}') THEN 3 ELSE 0 END FOR k IN keywords]), 0)"
            f" + CASE WHEN contains({path}, '{t}') THEN CASE WHEN contains(lower(split_part(file_path, '/', -1)), '{t}') THEN 3 ELSE 1.5 END ELSE 0 END"
            f" + CASE WHEN contains({name}, '{t}') THEN 2 ELSE 0 END)"
        )
        hits += [f"contains({x}, '{t}')::INT" for x in (title, body, path, name)]
        places.append(f"instr({body}, '{t}')")
    n = len(terms)
    return f""",
pointed AS (SELECT *, ({" + ".join(points)})::DOUBLE AS points, {" + ".join(hits)} AS hits, list_filter([{", ".join(places)}], lambda p: p > 0) AS places FROM facts),
near AS (SELECT *, CASE WHEN {n} > 1 AND hits > 1 AND len(places) > 1 THEN greatest(0.0::DOUBLE, 2.0::DOUBLE - ((list_max(places) - list_min(places)) / (len(places) - 1)) / 50.0::DOUBLE) ELSE 0.0::DOUBLE END AS proximity FROM pointed),
scored AS (SELECT *, points + hits * 5.0::DOUBLE / {n} + CASE WHEN hits = {n} THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END + proximity
    + CASE section_type WHEN 'code' THEN 1.0::DOUBLE WHEN 'documentation' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score FROM near WHERE hits > 0)"""


def markdown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a few documents each under headers of levels 1 to 3."""
    d = table(spark, sf_dir, "documents")
    head = F.concat(F.repeat(F.lit("#"), (F.lit(1) + F.col("doc_id") % 3).cast("int")), F.lit(" Doc "), F.col("doc_id").cast("string"), F.lit("\n"), "text")
    rows = d.groupBy(F.concat("source", F.lit("/part_"), F.floor(F.col("doc_id") / 200).cast("string"), F.lit(".md")).alias("path")).agg(F.array_sort(F.collect_list(F.struct("doc_id", head.alias("piece")))).alias("p"))
    return rows.select("path", F.array_join(F.transform("p", lambda x: x["piece"]), "\n").alias("content"))


MARKDOWN = r"""
md_files AS (SELECT source || '/part_' || (doc_id // 200) || '.md' AS path, string_agg(repeat('#', (1 + doc_id % 3)::INT) || ' Doc ' || doc_id || chr(10) || text, chr(10) ORDER BY doc_id) AS content
    FROM documents GROUP BY 1)"""


def rst_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with underlined titles; some underlines are too short to count."""
    d = table(spark, sf_dir, "documents")
    mark = F.element_at(F.split(F.lit("=-^\"="), ""), (F.col("doc_id") % 5 + 1).cast("int"))
    title = F.concat(F.lit("Title "), F.col("doc_id").cast("string"))
    head = F.concat(title, F.lit("\n"), F.repeat(mark, F.when(F.col("doc_id") % 7 == 0, 3).otherwise(F.length(title) + 1)), F.lit("\n"), "text")
    rows = d.groupBy(F.concat("source", F.lit("/part_"), F.floor(F.col("doc_id") / 200).cast("string"), F.lit(".rst")).alias("path")).agg(F.array_sort(F.collect_list(F.struct("doc_id", head.alias("piece")))).alias("p"))
    return rows.select("path", F.array_join(F.transform("p", lambda x: x["piece"]), "\n").alias("content"))


RST = r"""
rst_files AS (SELECT source || '/part_' || (doc_id // 200) || '.rst' AS path,
    string_agg('Title ' || doc_id || chr(10) || repeat(['=', '-', '^', '"', '='][doc_id % 5 + 1], CASE WHEN doc_id % 7 = 0 THEN 3 ELSE length('Title ' || doc_id) + 1 END) || chr(10) || text, chr(10) ORDER BY doc_id) AS content
    FROM documents GROUP BY 1)"""

PY_PIECES = (
    "def get_{k}(a, b=1, *args, **kw):\n    # size {s}\n    return a\n",
    'class P{k}(Base):\n    """Part {k}."""\n    x = {s}\n',
    "async def load_{k}(x, *, y):\n    pass  # TODO check {k}\n",
    "import mod_{k}\nfrom pkg_{s} import name_{k}, other\n",
)
JS_PIECES = (
    "export async function get{k}(a, b) {{\n  return a; // size {s}\n}}\n",
    "const f{k} = (x) => x + {s};\n",
    "export class C{k} extends Base {{\n}}\nclass D{k} {{ }}\n",
    "let g{k} = async (y) => y; // FIXME {k}\n/* part {k}\n * of size {s} */\n",
)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python and JavaScript files made of parts."""
    p = table(spark, sf_dir, "part")

    def piece(templates) -> F.Column:
        made = [F.concat(*(x for i, t in enumerate(_split(t)) for x in ([F.lit(t)] if i % 2 == 0 else [F.col({"k": "p_partkey", "s": "p_size"}[t]).cast("string")]))) for t in templates]
        return F.array(*made)[(F.col("p_partkey") % 4).cast("int")]

    number = F.floor(F.col("p_partkey") / 20).cast("string")
    both = p.select("p_partkey", F.explode(F.array(F.struct(F.concat(F.lit("src/mod_"), number, F.lit(".py")).alias("path"), piece(PY_PIECES).alias("piece")), F.struct(F.concat(F.lit("web/mod_"), number, F.lit(".js")).alias("path"), piece(JS_PIECES).alias("piece")))).alias("f"))
    rows = both.groupBy("f.path").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "f.piece"))).alias("p"))
    return rows.select("path", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("content"))


def _split(template: str) -> list[str]:
    """Text and field names in turn."""
    import re

    return [x.replace("{{", "{").replace("}}", "}") if i % 2 == 0 else x for i, x in enumerate(re.split(r"(?<!\{)\{(\w)\}", template))]


def _piece_sql(templates) -> str:
    made = []
    for t in templates:
        parts = _split(t)
        made.append(" || ".join("'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" if i % 2 == 0 else {"k": "p_partkey", "s": "p_size"}[x] for i, x in enumerate(parts)))
    return "[" + ", ".join(made) + "][p_partkey % 4 + 1]"


CODE = rf"""
code_files AS (SELECT path, string_agg(piece, '' ORDER BY p_partkey) AS content FROM (
    SELECT p_partkey, 'src/mod_' || (p_partkey // 20) || '.py' AS path, {_piece_sql(PY_PIECES)} AS piece FROM part
    UNION ALL SELECT p_partkey, 'web/mod_' || (p_partkey // 20) || '.js', {_piece_sql(JS_PIECES)} FROM part) GROUP BY path)"""

LINES = "lines AS (SELECT path, unnest(ls) AS x, unnest(range(1, len(ls) + 1)) AS n, len(ls) AS total FROM (SELECT path, string_split(content, chr(10)) AS ls FROM {}))"

FOLDERS = ["src/", "build/", "a/node_modules/", "docs/", ".git/", "lib/target/x", ""]
SUFFIXES = [".md", ".py", ".json", ".log", "", ".rst", ".JS", ".csv", ".ipynb", "/.env", "/.hidden", "/.notes.md", ".xml", ".tar.gz", "/mvnw"]


def file_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File metadata from pages: path, size, hash, page_id."""
    g = table(spark, sf_dir, "pages")
    pick = lambda xs: F.array(*map(F.lit, xs))[(F.col("page_id") % len(xs)).cast("int")]
    path = F.concat(pick(FOLDERS), F.regexp_extract("url", r"://([^?#]*)", 1), pick(SUFFIXES))
    return g.select("page_id", path.alias("path"), F.length("html").cast("bigint").alias("size"), F.sha2(F.col("html").cast("binary"), 256).alias("hash"))


FILES = rf"""
file_meta AS (SELECT page_id, {FOLDERS}[page_id % {len(FOLDERS)} + 1] || regexp_extract(url, '://([^?#]*)', 1) || {SUFFIXES}[page_id % {len(SUFFIXES)} + 1] AS path,
    length(html)::BIGINT AS size, sha256(encode(html)) AS hash FROM pages)"""

SUFFIX_SQL = r"lower(regexp_extract(split_part(path, '/', -1), '^.+(\.[^.]+)$', 1))"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("section_id"), "embedding", "vec_id")


def workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry made of the documents' sources."""
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("document_count"), F.countDistinct("lang").alias("code_symbol_count"), F.sum("n_chars").alias("chars"), F.min("doc_id").alias("first"))
    day = F.lpad((F.lit(1) + F.col("first") % 28).cast("string"), 2, "0")
    return d.select(
        F.concat(F.lit("ws_"), "source").alias("id"), F.col("source").alias("name"), F.concat(F.lit("/data/"), "source").alias("path"),
        F.when(F.col("first") % 7 == 3, F.lit("not a time")).otherwise(F.concat(F.lit("2024-01-"), day, F.lit("T10:00:00"))).alias("updated_at"),
        F.when(F.col("first") % 3 == 0, "inactive").otherwise("active").alias("status"), "document_count", "code_symbol_count", (F.col("document_count") * 2).alias("embedding_count"),
        (F.col("chars") / 1048576).alias("index_size_mb"), (F.lit(1.0) - (F.col("first") % 5) / 10).alias("health_score"),
    )


WORKSPACES = r"""
workspaces AS (SELECT 'ws_' || source AS id, source AS name, '/data/' || source AS path,
    CASE WHEN min(doc_id) % 7 = 3 THEN 'not a time' ELSE '2024-01-' || lpad((1 + min(doc_id) % 28)::VARCHAR, 2, '0') || 'T10:00:00' END AS updated_at,
    CASE WHEN min(doc_id) % 3 = 0 THEN 'inactive' ELSE 'active' END AS status, count(*)::BIGINT AS document_count, count(DISTINCT lang)::BIGINT AS code_symbol_count,
    (count(*) * 2)::BIGINT AS embedding_count, sum(n_chars)::DOUBLE / 1048576 AS index_size_mb, 1.0::DOUBLE - (min(doc_id) % 5)::DOUBLE / 10 AS health_score FROM documents GROUP BY source)"""
