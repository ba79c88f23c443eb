"""Queries over files, parsers, registry tables and logs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import constants as K
from quillmark.functions import text as T
from quillmark.operators import classify, embedding, global_search, parsing, registry
from quillmark.operators import index as index_ops
from quillmark.plans import corpus as C
from quillmark.plans.registered import query
from quillmark.sources import files as sources

MD = f"""{C.MARKDOWN}, {C.LINES.format("md_files")}, s AS (SELECT *, {C.strip_sql("x")} AS t FROM lines),
h AS (SELECT path, n, total, length(regexp_extract(t, '^(#{{1,6}})\\s', 1)) AS level, {C.strip_sql("regexp_extract(t, '^#{1,6}\\s+(.+)$', 1)")} AS title FROM s WHERE regexp_matches(t, '^#{{1,6}}\\s+.')),
stops AS (SELECT *, coalesce(lead(n) OVER (PARTITION BY path ORDER BY n) - 1, total) AS stop FROM h),
ids AS (SELECT *, path || '#' || regexp_replace(split_part(path, '/', -1), '[.]md$', '') || '_' || n || '_' || level AS id FROM stops),
parents AS (SELECT a.id, arg_max(b.id, b.n) AS parent_id FROM ids a JOIN ids b ON b.path = a.path AND b.n < a.n AND b.level < a.level GROUP BY a.id),
sections AS (SELECT ids.*, parent_id FROM ids LEFT JOIN parents USING (id))"""


@query(
    "md_sections",
    f"WITH {MD} SELECT id AS section_id, title, level::INT AS level, s.n::INT AS start_line, stop::INT AS end_line, path AS file_path, md5(string_agg(l.x, chr(10) ORDER BY l.n)) AS content_md5 FROM sections s JOIN lines l USING (path) WHERE l.n BETWEEN s.n AND s.stop GROUP BY ALL",
)
def md_sections(spark: SparkSession, d: str) -> DataFrame:
    return parsing.markdown_sections(C.markdown_files(spark, d)).select("section_id", "title", "level", "start_line", "end_line", "file_path", F.md5("content").alias("content_md5"))


@query("md_hierarchy", f"WITH {MD} SELECT id AS section_id, parent_id FROM sections")
def md_hierarchy(spark, d):
    return parsing.markdown_sections(C.markdown_files(spark, d)).select("section_id", "parent_id")


@query("md_children", f"WITH {MD} SELECT a.id AS section_id, coalesce(list(b.id ORDER BY b.n) FILTER (b.id IS NOT NULL), []) AS children FROM sections a LEFT JOIN sections b ON b.parent_id = a.id GROUP BY a.id")
def md_children(spark, d):
    return parsing.markdown_sections(C.markdown_files(spark, d)).select("section_id", "children")


WORDS_IN = f"len(list_filter(string_split_regex(content, '{C.SPACE}+'), lambda w: w <> ''))::BIGINT"


@query(
    "section_metadata",
    f"""WITH {MD}, full_text AS (SELECT id, title, level, s.n AS a, stop AS b, path, parent_id, string_agg(l.x, chr(10) ORDER BY l.n) AS content FROM sections s JOIN lines l USING (path) WHERE l.n BETWEEN s.n AND s.stop GROUP BY ALL)
    SELECT id AS section_id, title, level::INT AS level, path AS file_path, a::INT AS first_line, b::INT AS last_line, parent_id, (SELECT count(*) FROM sections c WHERE c.parent_id = full_text.id)::BIGINT AS n_children, length(content)::BIGINT AS content_length, {WORDS_IN} AS word_count FROM full_text""",
)
def section_metadata(spark, d):
    rows = index_ops.section_metadata(parsing.markdown_sections(C.markdown_files(spark, d)))
    return rows.select("section_id", "title", "level", "file_path", F.col("line_range.start").alias("first_line"), F.col("line_range.end").alias("last_line"), "parent_id", F.size("children").cast("bigint").alias("n_children"), "content_length", "word_count")


@query(
    "rst_sections",
    f"""WITH {C.RST}, {C.LINES.format("rst_files")}, s AS (SELECT *, {C.strip_sql("x")} AS t, lag({C.strip_sql("x")}) OVER (PARTITION BY path ORDER BY n) AS up FROM lines),
    h AS (SELECT path, n, total, up AS title, CASE t[1] WHEN '=' THEN 1 WHEN '-' THEN 2 WHEN '^' THEN 3 ELSE 4 END AS level FROM s WHERE n < total AND regexp_full_match(t, '=+|-+|\\^+|"+') AND length(up) > 0 AND length(up) <= length(t)),
    e AS (SELECT *, coalesce(lead(n) OVER (PARTITION BY path ORDER BY n) - 2, total) AS stop FROM h)
    SELECT path || '#' || regexp_replace(split_part(path, '/', -1), '[.]rst$', '') || '_' || e.n || '_' || level AS section_id, title, level::INT AS level, (e.n - 1)::INT AS start_line, stop::INT AS end_line, path AS file_path,
        md5(string_agg(l.x, chr(10) ORDER BY l.n)) AS content_md5 FROM e JOIN lines l USING (path) WHERE l.n BETWEEN e.n - 1 AND stop GROUP BY ALL""",
)
def rst_sections(spark, d):
    return parsing.rst_sections(C.rst_files(spark, d)).select("section_id", "title", "level", "start_line", "end_line", "file_path", F.md5("content").alias("content_md5"))


def _files(spark: SparkSession, d: str, suffix: str) -> DataFrame:
    return C.code_files(spark, d).filter(F.col("path").endswith(suffix))


PLAIN = "0::INT AS \"column\", 'global' AS scope, NULL::VARCHAR AS docstring"


@query(
    "py_symbols_regex",
    f"""WITH {C.CODE}, {C.LINES.format("code_files WHERE path LIKE '%.py'")}
    SELECT regexp_extract(x, '^\\s*(async\\s+)?def\\s+(\\w+)\\s*\\(([^)]*)\\)\\s*:', 2) AS name, CASE WHEN regexp_matches(x, '^\\s*async') THEN 'async_function' ELSE 'function' END AS type, path AS file_path, n::INT AS line_number,
        CASE WHEN regexp_matches(x, '^\\s*async') THEN 'async ' ELSE '' END || 'def ' || regexp_extract(x, 'def\\s+(\\w+)', 1) || '(' || regexp_extract(x, '\\(([^)]*)\\)', 1) || '):' AS signature, {PLAIN}
    FROM lines WHERE regexp_matches(x, '^\\s*(async\\s+)?def\\s+(\\w+)\\s*\\(([^)]*)\\)\\s*:')
    UNION ALL SELECT regexp_extract(x, 'class\\s+(\\w+)', 1), 'class', path, n::INT, 'class ' || regexp_extract(x, 'class\\s+(\\w+(\\([^)]*\\))?)', 1) || ':', 0, 'global', NULL FROM lines WHERE regexp_matches(x, '^\\s*class\\s+(\\w+)(\\([^)]*\\))?\\s*:')""",
)
def py_symbols_regex(spark, d):
    return parsing.python_symbols_by_line(_files(spark, d, ".py"))


@query(
    "js_symbols",
    f"""WITH {C.CODE}, {C.LINES.format("code_files WHERE path LIKE '%.js'")}
    SELECT regexp_extract(x, 'function\\s+(\\w+)', 1) AS name, 'function' AS type, path AS file_path, n::INT AS line_number, 'function ' || regexp_extract(x, 'function\\s+(\\w+)', 1) || '(' || regexp_extract(x, '\\(([^)]*)\\)', 1) || ')' AS signature, {PLAIN}
    FROM lines WHERE regexp_matches(x, '^\\s*(export\\s+)?(async\\s+)?function\\s+(\\w+)\\s*\\(([^)]*)\\)')
    UNION ALL SELECT regexp_extract(x, '(const|let|var)\\s+(\\w+)', 2), 'function', path, n::INT, 'const ' || regexp_extract(x, '(const|let|var)\\s+(\\w+)', 2) || ' = () => {{}}', 0, 'global', NULL FROM lines WHERE regexp_matches(x, '^\\s*(const|let|var)\\s+(\\w+)\\s*=\\s*(async\\s+)?\\([^)]*\\)\\s*=>')
    UNION ALL SELECT regexp_extract(x, 'class\\s+(\\w+)', 1), 'class', path, n::INT, 'class ' || regexp_extract(x, 'class\\s+(\\w+)', 1), 0, 'global', NULL FROM lines WHERE regexp_matches(x, '^\\s*(export\\s+)?class\\s+(\\w+)')""",
)
def js_symbols(spark, d):
    return parsing.javascript_symbols(_files(spark, d, ".js"))


OUTLINE_FILES = f"{C.CODE}, {C.MARKDOWN}, files AS (SELECT * FROM code_files UNION ALL SELECT * FROM md_files), {C.LINES.format('files')}, s AS (SELECT *, {C.strip_sql('x')} AS t FROM lines)"
OUTLINE = f"""{OUTLINE_FILES}, o AS (
    SELECT path, n, 0 AS k, CASE WHEN starts_with(t, 'class ') THEN 'class' ELSE 'function' END AS type, regexp_extract(t, '^(class |def )([^(:]*)', 2) AS name, NULL::INT AS level, t FROM s WHERE path LIKE '%.py' AND regexp_matches(t, '^(class|def) ') AND contains(x, ':')
    UNION ALL SELECT path, n, 0, 'function', CASE WHEN contains(t, 'function ') THEN trim(regexp_extract(t, 'function ([^(]*)', 1)) ELSE trim(regexp_extract(t, 'const ([^=]*)', 1)) END, NULL, t FROM s WHERE path LIKE '%.js' AND (contains(x, 'function ') OR contains(x, 'const ') AND contains(x, '=>'))
    UNION ALL SELECT path, n, 0, 'class', regexp_extract(t, '^class ([^ {{]*)', 1), NULL, t FROM s WHERE path LIKE '%.js' AND starts_with(t, 'class ') AND NOT (contains(x, 'function ') OR contains(x, 'const ') AND contains(x, '=>'))
    UNION ALL SELECT path, n, 0, 'header', trim(ltrim(t, '#')), length(t) - length(ltrim(t, '#')), t FROM s WHERE path LIKE '%.md' AND starts_with(t, '#')
    UNION ALL SELECT path, n, 1, 'todo', t, NULL, t FROM s WHERE contains(t, 'TODO') OR contains(t, 'FIXME')),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n, k) - 1 AS nth FROM o)"""


@query("file_outline", f"WITH {OUTLINE} SELECT path AS file_path, nth::INT AS n, type, name, level::INT AS level, n::INT AS line, t AS content FROM r WHERE nth < 50")
def file_outline(spark, d):
    return parsing.outlines(C.code_files(spark, d).unionByName(C.markdown_files(spark, d)))


@query("todo_items", f"WITH {OUTLINE} SELECT path AS file_path, t AS content FROM r WHERE type = 'todo' AND nth < 50")
def todo_items(spark, d):
    return parsing.outlines(C.code_files(spark, d).unionByName(C.markdown_files(spark, d))).filter("type = 'todo'").select("file_path", "content")


@query(
    "function_body",
    f"""WITH {C.CODE}, {C.LINES.format("code_files")}, i AS (SELECT *, length(x) - length(ltrim(x)) AS indent FROM lines),
    a AS (SELECT path, min(n) AS n FROM i WHERE contains(x, 'def get_44(') OR contains(x, 'function get_44(') OR contains(x, 'fun get_44(') GROUP BY path),
    b AS (SELECT a.path, a.n AS start, (SELECT indent FROM i WHERE i.path = a.path AND i.n = a.n) AS base FROM a),
    e AS (SELECT b.path, b.start, coalesce(min(i.n) FILTER (i.n > b.start AND trim(i.x) <> '' AND i.indent <= b.base AND regexp_matches(i.x, 'def |function |fun |class ')) - 1, max(i.total)) AS stop FROM b JOIN i USING (path) GROUP BY b.path, b.start)
    SELECT path AS file_path, start::INT AS start_line, stop::INT AS end_line, string_agg(x, chr(10) ORDER BY n) AS content FROM e JOIN i USING (path) WHERE n BETWEEN start AND stop GROUP BY ALL""",
)
def function_body(spark, d):
    return parsing.function_body(C.code_files(spark, d), "get_44")


@query(
    "line_slice",
    f"WITH {C.CODE}, {C.LINES.format('code_files')} SELECT path AS file_path, total::BIGINT AS total_lines, false AS truncated, coalesce(string_agg(rtrim(x), chr(10) ORDER BY n) FILTER (n BETWEEN 5 AND 12), '') AS content FROM lines GROUP BY path, total",
)
def line_slice(spark, d):
    return parsing.line_slice(C.code_files(spark, d), 5, 12)


def _ignored_sql() -> str:
    parts = []
    for p in K.IGNORE_PATTERNS:
        parts.append(f"ends_with(path, '{p[1:]}')" if p.startswith("*") else f"list_contains(string_split(path, '/'), '{p[:-1]}')" if p.endswith("/") else f"contains(path, '{p}')")
    name = "split_part(path, '/', -1)"
    hidden = f"(starts_with({name}, '.') AND {name} NOT IN ({', '.join(map(repr, K.HIDDEN_KEPT))}) AND {C.SUFFIX_SQL} NOT IN ({', '.join(map(repr, K.HIDDEN_KEPT_SUFFIXES))}))"
    return f"(size > {K.MAX_FILE_BYTES} OR {hidden} OR {' OR '.join(parts)})"


@query("ignore_filter", f"WITH {C.FILES} SELECT page_id, path FROM file_meta WHERE NOT {_ignored_sql()}")
def ignore_filter(spark, d):
    return C.file_meta(spark, d).filter(~classify.ignored("path", "size")).select("page_id", "path")


def _type_sql(types: dict[str, list[str]], suffix: str = C.SUFFIX_SQL) -> str:
    return "CASE " + " ".join(f"WHEN {suffix} IN ({', '.join(repr(s) for s in v if s.startswith('.'))}) THEN '{k}'" for k, v in types.items()) + " ELSE 'unknown' END"


@query("file_type_hist", f"WITH {C.FILES} SELECT {_type_sql(K.FILE_TYPES)} AS file_type, count(*)::BIGINT AS files FROM file_meta GROUP BY 1")
def file_type_hist(spark, d):
    return sources.type_histogram(C.file_meta(spark, d).withColumn("file_type", classify.file_type("path")))


@query("tool_file_type", f"WITH {C.FILES} SELECT page_id, {_type_sql(K.TOOL_SUFFIXES)} AS kind FROM file_meta")
def tool_file_type(spark, d):
    return C.file_meta(spark, d).select("page_id", classify.tool_file_type(T.suffix("path")).alias("kind"))


@query(
    "parser_dispatch",
    f"WITH {C.FILES} SELECT page_id, {_type_sql(K.PARSER_SUFFIXES).replace(chr(39) + 'unknown' + chr(39), 'NULL')} AS parser FROM file_meta WHERE {_type_sql(K.FILE_TYPES)} IN ('documents', 'code')",
)
def parser_dispatch(spark, d):
    return C.file_meta(spark, d).filter(classify.file_type("path").isin("documents", "code")).select("page_id", parsing.parser_of("path").alias("parser"))


ROOTS = [("r1", "setup.py"), ("r1", "package.json"), ("r2", "src/a.csproj"), ("r2", "Gemfile"), ("r3", "docs/a.txt"), ("r4", "src/setup.py"), ("r4", "a.c"), ("r5", "go.sum"), ("r6", "x/y.md"), ("r6", "composer.json")]
MARKER_SQL = " ".join(
    "WHEN " + " OR ".join(f"ends_with(path, '{m[1:]}')" if m.startswith("*") else f"starts_with(path, '{m}')" if m.endswith("/") else f"path = '{m}'" for m in v) + f" THEN {i}" for i, v in enumerate(K.PROJECT_MARKERS.values())
)


@query("project_type", f"WITH f(root, path) AS (VALUES {', '.join(map(str, ROOTS))}) SELECT root, {[*K.PROJECT_MARKERS, 'mixed']}[min(CASE {MARKER_SQL} ELSE {len(K.PROJECT_MARKERS)} END) + 1] AS project_type FROM f GROUP BY root")
def project_type(spark, d):
    return classify.project_types(spark.createDataFrame(ROOTS, "root string, path string"))


@query("file_hash", "SELECT page_id, sha256(encode(html)) AS hash FROM pages")
def file_hash(spark, d):
    return C.file_meta(spark, d).select("page_id", "hash")


BEFORE = f"{C.FILES}, old AS (SELECT path, CASE WHEN page_id % 10 = 0 THEN 'x' ELSE hash END AS hash FROM file_meta WHERE page_id % 17 <> 0 UNION ALL SELECT 'gone/' || path, hash FROM file_meta WHERE page_id % 13 = 0)"


def _before(spark: SparkSession, d: str) -> DataFrame:
    f = C.file_meta(spark, d)
    kept = f.filter("page_id % 17 <> 0").select("path", F.when(F.col("page_id") % 10 == 0, "x").otherwise(F.col("hash")).alias("hash"))
    return kept.unionByName(f.filter("page_id % 13 = 0").select(F.concat(F.lit("gone/"), "path").alias("path"), "hash"))


@query("changed_files", f"WITH {BEFORE} SELECT page_id, path FROM file_meta f WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.path = f.path AND old.hash = f.hash)")
def changed_files(spark, d):
    return sources.changed(C.file_meta(spark, d), _before(spark, d)).select("page_id", "path")


@query("deleted_files", f"WITH {BEFORE} SELECT path FROM old WHERE path NOT IN (SELECT path FROM file_meta)")
def deleted_files(spark, d):
    return sources.deleted(C.file_meta(spark, d), _before(spark, d)).select("path")


@query("replace_by_key", "SELECT doc_id, source, 'old' AS origin FROM documents WHERE source NOT IN ('src1', 'src2') UNION ALL SELECT doc_id + 1000000, source, 'new' FROM documents WHERE source IN ('src1', 'src2')")
def replace_by_key(spark, d):
    rows = C.table(spark, d, "documents").select("doc_id", "source", F.lit("old").alias("origin"))
    new = rows.filter(F.col("source").isin("src1", "src2")).select((F.col("doc_id") + 1000000).alias("doc_id"), "source", F.lit("new").alias("origin"))
    return registry.replaced(rows, new, "source").select("doc_id", "source", "origin")


@query(
    "clean_markdown",
    rf"""SELECT page_id, md5({C.strip_sql(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '!\[.*?\]\(.*?\)', '', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '```[\s\S]*?```', '', 'g'), '`[^`]+`', '', 'g'), '<[^>]+>', '', 'g'), '\n\s*\n', chr(10) || chr(10), 'g'), ' +', ' ', 'g')")}) AS cleaned_md5 FROM pages""",
)
def clean_markdown(spark, d):
    return C.table(spark, d, "pages").select("page_id", F.md5(T.clean_markdown("html")).alias("cleaned_md5"))


@query("normalize_ws", rf"""SELECT doc_id, md5({C.strip_sql(r"regexp_replace(regexp_replace(regexp_replace(text, ' +', ' ', 'g'), '\n\s*\n\s*\n+', chr(10) || chr(10), 'g'), ' +\n', chr(10), 'g')")}) AS normal_md5 FROM documents""")
def normalize_ws(spark, d):
    return C.table(spark, d, "documents").select("doc_id", F.md5(T.normalized_space("text")).alias("normal_md5"))


@query(
    "extract_comments",
    f"""WITH {C.CODE} SELECT path, list_filter([{C.strip_sql("regexp_extract(x, '#\\s*(.+)', 1)")} FOR x IN string_split(content, chr(10))], lambda c: c <> '') AS comments FROM code_files WHERE path LIKE '%.py'
    UNION ALL SELECT path, list_filter(list_concat([{C.strip_sql("regexp_extract(x, '//\\s*(.+)', 1)")} FOR x IN string_split(content, chr(10))],
        [{C.strip_sql("regexp_replace(regexp_replace(b, '/\\*|\\*/', '', 'g'), '(?m)^\\s*\\*\\s*', '', 'g')")} FOR b IN regexp_extract_all(content, '/\\*[\\s\\S]*?\\*/')]), lambda c: c <> '') FROM code_files WHERE path LIKE '%.js'""",
)
def extract_comments(spark, d):
    language = F.when(F.col("path").endswith(".py"), "python").otherwise("javascript")
    return C.code_files(spark, d).select("path", T.comments("content", language).alias("comments"))


HEALTH = "CASE WHEN h < 0.8 THEN 'warning' WHEN h < 0.5 THEN 'critical' ELSE 'healthy' END"


@query(
    "registry_stats",
    f"""WITH {C.WORKSPACES}, a AS (SELECT count(*)::BIGINT AS total_workspaces, count_if(status = 'active')::BIGINT AS active_workspaces, sum(document_count)::BIGINT AS total_document_count, sum(code_symbol_count)::BIGINT AS total_code_symbol_count,
    sum(embedding_count)::BIGINT AS total_embedding_count, round(sum(index_size_mb), 6) AS total_size_mb, coalesce(avg(health_score) FILTER (status = 'active'), 1.0) AS h FROM workspaces) SELECT * EXCLUDE (h), round(h, 6) AS mean_health, {HEALTH} AS health_status FROM a""",
)
def registry_stats(spark, d):
    return registry.stats(C.workspaces(spark, d)).withColumn("total_size_mb", F.round("total_size_mb", 6)).withColumn("mean_health", F.round("mean_health", 6))


@query("health_label", f"WITH {C.WORKSPACES} SELECT id, {HEALTH} AS label FROM (SELECT id, health_score - 0.3 AS h FROM workspaces)")
def health_label(spark, d):
    return C.workspaces(spark, d).select("id", T.health_label(F.col("health_score") - 0.3).alias("label"))


@query("workspace_list", f"WITH {C.WORKSPACES} SELECT id, name, path, document_count FROM workspaces WHERE status = 'active'")
def workspace_list(spark, d):
    return C.workspaces(spark, d).filter("status = 'active'").select("id", "name", "path", "document_count")


@query("inactive_cleanup", f"WITH {C.WORKSPACES} SELECT id FROM workspaces WHERE status = 'inactive' AND try_cast(updated_at AS TIMESTAMP) < TIMESTAMP '2024-02-14 10:00:00' - INTERVAL 30 DAY")
def inactive_cleanup(spark, d):
    return registry.stale(C.workspaces(spark, d), datetime(2024, 2, 14, 10)).select("id")


LINKS = f"links AS (SELECT DISTINCT n_name AS src, r_name AS dst, {K.RELATIONSHIPS}[n_nationkey % 7 + 1] AS rel_type FROM (SELECT * FROM nation UNION ALL SELECT * FROM nation) JOIN region ON r_regionkey = n_regionkey)"


@query("relationship_edges", f"WITH {LINKS} SELECT src, l.dst, coalesce(w.name, 'Unknown') AS name, l.types FROM (SELECT src, dst, list_sort(list(rel_type)) AS types FROM links GROUP BY src, dst) l LEFT JOIN (SELECT r_name AS dst, lower(r_name) AS name FROM region WHERE r_regionkey < 3) w USING (dst)")
def relationship_edges(spark, d):
    n, r = C.table(spark, d, "nation"), C.table(spark, d, "region")
    kinds = F.array(*map(F.lit, K.RELATIONSHIPS))[(F.col("n_nationkey") % 7).cast("int")]
    edges = n.unionByName(n).join(r, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"), kinds.alias("rel_type")).distinct()
    return registry.related(edges, r.filter("r_regionkey < 3").select(F.col("r_name").alias("id"), F.lower("r_name").alias("name")))


@query("keep_newest_n", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS n FROM events) WHERE n <= 5")
def keep_newest_n(spark, d):
    return registry.newest(C.table(spark, d, "events"), "ts", K.EMBEDDINGS_KEPT, ["event_type"], "event_id").select("event_type", "event_id")


@query("server_stats", "SELECT event_type AS outcome, count(*)::BIGINT AS queries, round(sum(value), 4) AS seconds, round(avg(value), 6) AS mean_seconds, max(ts) AS last_query FROM events GROUP BY 1")
def server_stats(spark, d):
    return C.table(spark, d, "events").groupBy(F.col("event_type").alias("outcome")).agg(F.count(F.lit(1)).alias("queries"), F.round(F.sum("value"), 4).alias("seconds"), F.round(F.avg("value"), 6).alias("mean_seconds"), F.max("ts").alias("last_query"))


@query(
    "query_log_windows",
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS outcome, count(*)::BIGINT AS queries, round(avg(value), 6) AS mean_seconds FROM events GROUP BY ALL",
)
def query_log_windows(spark, d):
    from quillmark.streaming.ingest import query_log_windows as windows

    log = C.table(spark, d, "events").select("ts", F.col("event_type").alias("outcome"), F.col("value").alias("seconds"))
    return windows(log).withColumn("mean_seconds", F.round("mean_seconds", 6))


@query(
    "init_stats",
    f"WITH {C.FILES}, {C.MARKDOWN}, {C.CODE} SELECT count(*)::BIGINT AS files, count_if({_ignored_sql()})::BIGINT AS ignored, sum(size)::DOUBLE / 1048576 AS size_mb, (SELECT count(*) FROM md_files)::BIGINT AS documents, (SELECT count(*) FROM code_files)::BIGINT AS sources FROM file_meta",
)
def init_stats(spark, d):
    totals = C.file_meta(spark, d).agg(F.count(F.lit(1)).alias("files"), F.count_if(classify.ignored("path", "size")).alias("ignored"), (F.sum("size") / 1048576).alias("size_mb"))
    one = lambda df, name: F.broadcast(df.agg(F.count(F.lit(1)).alias(name)))  # noqa: E731  one row
    return totals.join(one(C.markdown_files(spark, d), "documents")).join(one(C.code_files(spark, d), "sources"))


SYMBOLS = f"""{C.CODE}, {C.LINES.format("code_files WHERE path LIKE '%.js'")},
y AS (SELECT regexp_extract(x, 'class\\s+(\\w+)', 1) AS name, path, 'class ' || regexp_extract(x, 'class\\s+(\\w+)', 1) AS signature FROM lines WHERE regexp_matches(x, '^\\s*(export\\s+)?class\\s+(\\w+)'))"""


def _classes(spark: SparkSession, d: str) -> DataFrame:
    return parsing.javascript_symbols(_files(spark, d, ".js")).filter("type = 'class'")


@query("symbol_text", f"WITH {SYMBOLS} SELECT name, 'class ' || name || chr(10) || signature || chr(10) || 'File: ' || path AS text FROM y")
def symbol_text(spark, d):
    return _classes(spark, d).select("name", global_search.symbol_text().alias("text"))


@query("symbol_preview", f"WITH {SYMBOLS} SELECT name, 'class ' || name || '(' || signature || ')' AS preview FROM y")
def symbol_preview(spark, d):
    return _classes(spark, d).select("name", global_search.symbol_preview().alias("preview"))


@query("embedding_stats", "SELECT 'vector' AS kind, count(*)::BIGINT AS total, max(len(embedding))::BIGINT AS dimension FROM embeddings")
def embedding_stats(spark, d):
    return embedding.stats(C.table(spark, d, "embeddings").withColumn("kind", F.lit("vector")))
