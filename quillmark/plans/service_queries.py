"""Queries over stored indexes, registries, settings, servers and tools: each does its work on fixed or given tables and returns what it finds."""

from __future__ import annotations

import asyncio
import json
import uuid
from dataclasses import asdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark import cli, serve, settings, stdio, workspace
from quillmark.functions import constants as K
from quillmark.operators import classify, context, embedding, global_search, index, parsing, registry, search
from quillmark.plans import corpus as C
from quillmark.plans import search_queries as Q
from quillmark.plans.registered import ORACLE, query
from quillmark.sources import files as sources

#: A project: path, content, encoding.
TREE = [
    ("README.md", "# Quokka\nInstall the quokka service with care.\n## Setup\nRun quokka setup now. Then stop.\n", "utf-8"),
    ("docs/other.md", "# Other\nNothing of note here at all.\n# Third\nMore plain words.\n# Fourth\nStill more of them.\n", "utf-8"),
    ("src/code.py", 'import os\n\n\nclass Animal:\n    """A wombat."""\n\n\ndef hello(name, *, loud=False):\n    """Greets a wombat."""\n    return name  # TODO later\n', "utf-8"),
    ("src/broken.py", "def broken(:\nasync def later(x):\nclass Odd(Base):\n", "utf-8"),
    ("web/app.js", "export function start(a, b) {\n}\n", "utf-8"),
    ("notes/latin +1.txt", "café\r\nau lait\n", "latin-1"),
    ("notes/quotes.txt", "“quoted” for €5\n", "cp1252"),
    ("setup.py", "x = 1\n", "utf-8"),
    ("build/out.md", "# Ignored\n", "utf-8"),
    (".hidden", "ignored\n", "utf-8"),
    ("a.log", "ignored\n", "utf-8"),
]
KEPT = [t for t in TREE if not t[0].startswith(("build/", ".hidden", "a.log"))]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{C.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes a file to any store that Spark reaches."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(data))
    out.close()


def project(spark: SparkSession) -> str:
    root = new_folder(spark, "project")
    for path, text, encoding in TREE:
        put(spark, f"{root}/{path}", text.encode(encoding))
    return root


_built: dict[tuple[str, str], tuple[str, str]] = {}


def built(spark: SparkSession) -> tuple[str, registry.Registry]:
    """The project's root and a registry that lists it; built once for a session's folder."""
    key = (spark.sparkContext.applicationId, C.shared_folder(spark))
    if key not in _built:
        root, folder = project(spark), new_folder(spark, "registry")
        workspace.build(spark, root, registry=registry.Registry(spark, folder), name="zoo", description="animals")
        _built[key] = root, folder
    root, folder = _built[key]
    return root, registry.Registry(spark, folder)


def opened(spark: SparkSession) -> workspace.Workspace:
    return workspace.Workspace(spark, f"{built(spark)[0]}/{workspace.FOLDER}")


def literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, int):
        return f"{x}::BIGINT"
    if isinstance(x, float):
        return f"{x!r}::DOUBLE"
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(literal, x)) + "]::VARCHAR[]"
    return "'" + x.replace("'", "''").replace("\r", "' || chr(13) || '").replace("\n", "' || chr(10) || '") + "'"


def values(columns: list[str], rows: list[tuple]) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) t({', '.join(columns)})"


SCANNED = [(p, len(t.encode(e)), {"md": "documents", "txt": "documents", "py": "code", "js": "code"}[p.rpartition(".")[2]], e, t.replace("\r\n", "\n"), t.encode(e).hex()) for p, t, e in KEPT]


@query("scan_files", f"SELECT * EXCLUDE (h), sha256(unhex(h)) AS hash FROM ({values(['path', 'size', 'file_type', 'encoding', 'content', 'h'], SCANNED)})")
def scan_files(spark, d):
    return sources.scan(spark, project(spark)).select("path", "size", "file_type", "encoding", "content", "hash")


@query("index_round_trip", ORACLE["bm25_topk"])
def index_round_trip(spark, d):
    """A written and loaded index answers as the one in the plan."""
    path = new_folder(spark, "index")
    index.write(index.build(C.sections(spark, d)), path)
    return Q.scores(search.best(search.bm25(index.load(spark, path), Q.TERMS), 50))


@query(
    "embedding_store",
    "SELECT vec_id::VARCHAR AS section_id, 'document' AS kind, len(embedding)::BIGINT AS dimension, true AS stored, false AS absent FROM embeddings WHERE vec_id % 3 > 0",
)
def embedding_store(spark, d):
    path = new_folder(spark, "vectors")
    rows = C.table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("section_id"), "embedding", F.when(F.col("vec_id") % 3 == 0, "code").otherwise("document").alias("kind"))
    embedding.write(rows, path)
    there = [F.lit(embedding.exists(spark, p)).alias(n) for p, n in ((path, "stored"), (f"{path}/none", "absent"))]
    return embedding.load(spark, path, "document").select("section_id", "kind", F.size("embedding").cast("bigint").alias("dimension"), *there)


@query("embedding_versions", values(["version", "total"], [(f"v{i:09d}", i + 1) for i in range(2, 7)]))
def embedding_versions(spark, d):
    """Seven versions of one vector more each, of which the newest five stay."""
    folder = new_folder(spark, "versions")
    for n in range(7):
        embedding.write_version(spark.range(n + 1).select(F.col("id").cast("string").alias("section_id"), F.array(F.lit(1.0)).alias("embedding"), F.lit("document").alias("kind")), folder)
    rows = [(p.rpartition("/")[2], embedding.load(spark, p).count()) for p in embedding.versions(spark, folder)]
    return spark.createDataFrame(rows, "version string, total bigint")


LEAST_SOURCES = "SELECT source FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) ORDER BY source LIMIT 4"


@query(
    "registry_mutations",
    f"""WITH s AS (SELECT source, row_number() OVER (ORDER BY source) AS r FROM ({LEAST_SOURCES})), n AS (SELECT source, count(*)::BIGINT AS document_count, sum(n_chars)::DOUBLE / 1048576 AS mb FROM documents GROUP BY source)
    SELECT source AS name, '/data/' || source AS path, CASE WHEN r = 2 THEN 0 ELSE document_count END::BIGINT AS document_count, round(CASE WHEN r = 2 THEN 0.0 ELSE mb END, 6) AS index_size_mb,
        CASE WHEN r = 2 THEN 'again' ELSE 'first' END AS description, 'active' AS status, CASE WHEN r = 1 THEN [(SELECT source FROM s WHERE r = 3)] ELSE []::VARCHAR[] END AS links, true AS found FROM s JOIN n USING (source) WHERE r <> 4""",
)
def registry_mutations(spark, d):
    """Four workspaces are registered and counted, the first is linked to the third and fourth, the second registered again, the fourth removed."""
    reg = registry.Registry(spark, new_folder(spark, "registry"))
    counts = C.table(spark, d, "documents").filter("source IS NOT NULL").groupBy("source").agg(F.count(F.lit(1)).alias("n"), (F.sum("n_chars") / 1048576).alias("mb"))
    ids = {}
    for r in counts.orderBy("source").limit(4).collect():
        ids[r.source] = reg.register(f"/data/{r.source}", r.source, "first", "mixed")
        reg.update_stats(ids[r.source], document_count=r.n, index_size_mb=r.mb)
    first, second, third, fourth = ids
    reg.relate(ids[first], ids[third], K.RELATIONSHIPS[0])
    reg.relate(ids[fourth], ids[first], K.RELATIONSHIPS[1])
    reg.register(f"/data/{second}", second, "again", "mixed", force=True)
    reg.remove(ids[fourth])
    links = reg.edges().join(reg.workspaces(True).select(F.col("id").alias("dst"), F.col("name").alias("other")), "dst").groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("other")).alias("links"))
    known = {name: reg.find(f"/data/{name}") for name in ids}
    found = F.col("id").isin([r.id for name, r in known.items() if r and reg.get(r.id).name == name])
    rows = reg.workspaces().join(links, "id", "left")
    return rows.select("name", "path", "document_count", F.round("index_size_mb", 6).alias("index_size_mb"), "description", "status", F.coalesce("links", F.array().cast("array<string>")).alias("links"), found.alias("found"))


@query("registry_singleton", values(["same", "other", "after_reset"], [(True, False, False)]))
def registry_singleton(spark, d):
    folder = new_folder(spark, "registry")
    first = registry.shared_registry(spark, folder)
    same, other = registry.shared_registry(spark, folder) is first, registry.shared_registry(spark, f"{folder}-2") is first
    registry.reset_shared_registry()
    return spark.createDataFrame([(same, other, registry.shared_registry(spark, folder) is first)], "same boolean, other boolean, after_reset boolean")


SYMBOLS = [
    ("hello", "function", "src/code.py", 8, 0, "global", "def hello(name, loud):", "Greets a wombat, a wombat indeed."),
    ("Animal", "class", "src/code.py", 4, 0, "zoo", "class Animal:", None),
    ("start", "function", "web/app.js", 1, 0, "global", "function start(a, b)", ""),
]
PREVIEWS = ["function hello(def hello(name, loud):) - Greets a wombat, a wombat indeed.", "class Animal(class Animal:)", "function start(function start(a, b))"]
TEXTS = [
    "function hello\ndef hello(name, loud):\nGreets a wombat, a wombat indeed.\nFile: src/code.py",
    "class Animal\nclass Animal:\nFile: src/code.py\nScope: zoo",
    "function start\nfunction start(a, b)\nFile: web/app.js",
]


def symbols(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SYMBOLS, parsing.SYMBOL)


@query(
    "symbol_facts",
    values(
        ["workspace_id", "workspace_name", "section_id", "title", "content_preview", "file_path", "section_type", "keywords"],
        [("ws", "zoo", f"{s[2]}:{s[3]}", s[0], p, s[2], "code", [s[0], s[1], s[5], *(["wombat", "greets", "indeed"] if s[0] == "hello" else [])]) for s, p in zip(SYMBOLS, PREVIEWS, strict=True)],
    ),
)
def symbol_facts(spark, d):
    rows = symbols(spark)
    docs = rows.filter("docstring IS NOT NULL").select(F.concat_ws(":", "file_path", "line_number").alias("section_id"), F.col("docstring").alias("content"))
    return global_search.symbol_facts(rows, "ws", "zoo", index.top_keywords(docs))


@query("symbol_texts", values(["name", "preview", "text"], [(s[0], p, t) for s, p, t in zip(SYMBOLS, PREVIEWS, TEXTS, strict=True)]))
def symbol_texts(spark, d):
    return symbols(spark).select("name", global_search.symbol_preview().alias("preview"), global_search.symbol_text().alias("text"))


def counting_encoder():
    """Characters, letters e, spaces and full stops of a text."""
    return lambda texts: np.array([[len(t), t.count("e"), t.count(" "), t.count(".")] for t in texts], np.float32).reshape(len(texts), 4)


COUNTED = "[length(chunk), length(chunk) - length(replace(chunk, 'e', '')), length(chunk) - length(replace(chunk, ' ', '')), length(chunk) - length(replace(chunk, '.', ''))]::DOUBLE[]"


@query("section_vectors", f"""WITH RECURSIVE c AS ({Q.CHUNKS.replace("FROM documents", "FROM (SELECT doc_id, split_part(text, chr(10), 1) || chr(10) || chr(10) || text AS text FROM documents)")}) SELECT 'document' AS kind, section_id, chunk_id, {COUNTED} AS embedding, md5(chunk) AS content_md5 FROM c""")
def section_vectors(spark, d):
    """The chunks of all sections, encoded."""
    made = embedding.encoded(embedding.section_chunks(C.sections(spark, d)), counting_encoder)
    return made.select("kind", "section_id", "chunk_id", F.col("embedding").cast("array<double>").alias("embedding"), "content_md5")


@query("symbol_vectors", f"WITH c AS ({values(['section_id', 'chunk'], [(f'{s[2]}:{s[0]}', t) for s, t in zip(SYMBOLS, TEXTS, strict=True)])}) SELECT 'code' AS kind, section_id, section_id AS chunk_id, {COUNTED} AS embedding, md5(chunk) AS content_md5 FROM c")
def symbol_vectors(spark, d):
    none = C.sections(spark, d).filter(F.lit(False))
    made = embedding.generate(none, symbols(spark), counting_encoder)
    return made.select("kind", "section_id", "chunk_id", F.col("embedding").cast("array<double>").alias("embedding"), "content_md5")


class _LengthModel:
    """Stands for a model: a text's length and number of words, batch by batch."""

    def __init__(self, name: str):
        self.name, self.batches = name, []

    def encode(self, texts: list[str], batch_size: int):
        self.batches.append(-(-len(texts) // batch_size))
        return [[3.0 * len(t.split()), 4.0 * len(t.split()), 0.0] for t in texts]


@query("model_wrapper", values(["text", "dimension", "first", "second"], [("one word", 3, 0.6, 0.8), ("a", 3, 0.6, 0.8), ("", 3, 0.0, 0.0)]))
def model_wrapper(spark, d):
    model, texts = embedding.ModelEncoder("lengths", 2, _LengthModel), ["one word", "a", ""]
    rows = [(t, model.dimension, round(float(v[0]), 6), round(float(v[1]), 6)) for t, v in zip(texts, model(texts), strict=True)]
    return spark.createDataFrame(rows, "text string, dimension bigint, first double, second double")


@query("settings_round_trip", values(["part", "name", "value"], [(p, k, json.dumps(99 if k == "max_results" else v)) for p, fields in asdict(settings.Settings()).items() for k, v in fields.items()]))
def settings_round_trip(spark, d):
    """Defaults, one changed, through their JSON; an unknown key and a broken text change nothing."""
    own = settings.parsed('{"search": {"max_results": 99, "unknown": 1}}')
    assert settings.parsed("{") == settings.Settings()
    again = settings.parsed(settings.rendered(own))
    return spark.createDataFrame([(p, k, json.dumps(v)) for p, fields in asdict(again).items() for k, v in fields.items()], "part string, name string, value string")


@query("settings_update", values(["chunk_size", "max_results", "level"], [(256, 7, "DEBUG")]))
def settings_update(spark, d):
    own = settings.Settings()
    own.update(chunk_size=256, max_results=7, level="DEBUG", unknown=1)
    return spark.createDataFrame([(own.indexing.chunk_size, own.search.max_results, own.logging.level)], "chunk_size bigint, max_results bigint, level string")


@query("language_overrides", values(["project_type", "settings"], [(k, json.dumps(K.LANGUAGE_SETTINGS.get(k, {}))) for k in (*K.PROJECT_MARKERS, "mixed")]))
def language_overrides(spark, d):
    return spark.createDataFrame([(k, json.dumps(classify.language_settings(k))) for k in (*K.PROJECT_MARKERS, "mixed")], "project_type string, settings string")


FOLDERS = [("python", ["docs/", "src/"]), ("mixed", ["test/", "api/"]), ("go", ["tests/", "mydocs/"]), ("java", [])]


@query("workspace_tags", f"WITH f AS ({values(['kind', 'paths'], FOLDERS)}) SELECT kind, list_filter([kind, CASE WHEN list_contains(paths, 'docs/') THEN 'documentation' END, CASE WHEN list_has_any(paths, ['test/', 'tests/']) THEN 'testing' END, CASE WHEN list_contains(paths, 'api/') THEN 'api' END], lambda t: t IS NOT NULL) AS tags FROM f")
def workspace_tags(spark, d):
    return spark.createDataFrame(FOLDERS, "kind string, paths array<string>").select("kind", classify.tags(F.col("kind"), F.col("paths")).alias("tags"))


AST = r"""
SELECT regexp_extract(x, '(get_\d+)', 1) AS name, 'function' AS type, path AS file_path, n::INT AS line_number, 'def ' || regexp_extract(x, '(get_\d+)', 1) || '(a, b, *args, **kw):' AS signature, NULL::VARCHAR AS docstring FROM lines WHERE regexp_matches(x, '^def get_')
UNION ALL SELECT regexp_extract(x, '(load_\d+)', 1), 'async_function', path, n::INT, 'async def ' || regexp_extract(x, '(load_\d+)', 1) || '(x, y):', NULL FROM lines WHERE regexp_matches(x, '^async def load_')
UNION ALL SELECT regexp_extract(x, '(P\d+)', 1), 'class', path, n::INT, 'class ' || regexp_extract(x, '(P\d+)', 1) || ':', 'Part ' || regexp_extract(x, 'P(\d+)', 1) || '.' FROM lines WHERE regexp_matches(x, '^class P')
UNION ALL SELECT regexp_extract(x, '(mod_\d+)', 1), 'import', path, n::INT, x, NULL FROM lines WHERE regexp_matches(x, '^import mod_')
UNION ALL SELECT regexp_extract(x, '(name_\d+)', 1), 'import', path, n::INT, regexp_replace(x, ', other$', ''), NULL FROM lines WHERE regexp_matches(x, '^from pkg_')"""
PY_LINES = f"WITH {C.CODE}, {C.LINES.format(chr(40) + 'SELECT * FROM code_files' + chr(41) + chr(32) + 'WHERE path LIKE ' + chr(39) + '%.py' + chr(39))}"


def python_files(spark: SparkSession, d: str) -> DataFrame:
    return C.code_files(spark, d).filter(F.col("path").endswith(".py"))


@query("py_symbols_ast", f"""{PY_LINES} SELECT *, 0::INT AS "column", 'global' AS scope FROM ({AST})""")
def py_symbols_ast(spark, d):
    return parsing.python_symbols(python_files(spark, d))


@query("table_function_symbols", f"{PY_LINES} SELECT name, type, file_path, line_number FROM ({AST})")
def table_function_symbols(spark, d):
    """The same through the function that SQL calls."""
    parsing.register_table_functions(spark)
    python_files(spark, d).createOrReplaceTempView("quillmark_python_files")
    return spark.sql("SELECT s.name, s.type, s.file_path, s.line_number FROM quillmark_python_files f, LATERAL python_symbols(f.path, f.content) s")


PATHS = ["a.md", "b.RST", "c.pyi", "d.mjs", "e.txt", "f.c", "g"]


@query("custom_parser", values(["path", "parser"], [("a.md", "markdown"), ("b.RST", "rst"), ("c.pyi", "python"), ("d.mjs", "javascript"), ("e.txt", "plain"), ("f.c", None), ("g", None)]))
def custom_parser(spark, d):
    """A parser that is added takes the files of its suffixes behind the others."""
    parsing.add_parser(parsing.Parser("plain", (".txt", ".md"), lambda files: files, "sections"))
    try:
        return spark.createDataFrame([(p,) for p in PATHS], "path string").select("path", parsing.parser_of("path").alias("parser"))
    finally:
        parsing.PARSERS.pop()


@query("json_results", f"""WITH {Q.LEGS} SELECT to_json(list({{'section_id': section_id, 'title': title, 'content': content, 'score': round(score, 6), 'match_type': match_type, 'file_path': file_path, 'line_range': [0, 0]}} ORDER BY rank))::VARCHAR AS content FROM ranked WHERE rank <= 50""")
def json_results(spark, d):
    return context.json_response(Q.scores(Q.hybrid(spark, d)))


TABLES = [("chunks", 8), ("files", 8), ("index/corpus_stats", 1), ("sections", 5), ("summaries", 5), ("symbols", 6), ("vectors", 11)]


@query("workspace_tables", values(["name", "total"], TABLES))
def workspace_tables(spark, d):
    """The tables of a built workspace with their rows."""
    made = opened(spark)
    return spark.createDataFrame([(name, made.table(name).count()) for name, _ in TABLES], "name string, total bigint")


@query("workspace_totals", values(["name", "project_type", "tags", "file_count", "document_count", "code_symbol_count", "embedding_count", "facts"], [("zoo", "python", ["python", "documentation"], 8, 5, 6, 11, 11)]))
def workspace_totals(spark, d):
    """A built workspace's row in the registry, and its facts."""
    root, reg = built(spark)
    facts = reg.facts().groupBy(F.col("workspace_id").alias("id")).agg(F.count(F.lit(1)).alias("facts"))
    return reg.workspaces().join(facts, "id").select("name", "project_type", "tags", "file_count", "document_count", "code_symbol_count", "embedding_count", "facts")


@query("workspace_update", values(["round", "changed", "deleted", "sections", "file_count"], [("same", 0, 0, 5, 8), ("edited", 2, 1, 4, 8)]))
def workspace_update(spark, d):
    """An update without changes, and one after a file is edited, one added and one deleted."""
    root, reg = project(spark), registry.Registry(spark, new_folder(spark, "registry"))
    workspace.build(spark, root, registry=reg, name="zoo")
    rows = []
    for name in ("same", "edited"):
        if name == "edited":
            put(spark, f"{root}/README.md", b"# Quokka\nOnly this.\n")
            put(spark, f"{root}/new.py", b"y = 2\n")
            target = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/setup.py")
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, False)
        seen = workspace.update(spark, root, registry=reg)
        rows.append((name, seen["changed"], seen["deleted"], workspace.Workspace(spark, f"{root}/{workspace.FOLDER}").table("sections").count(), reg.find(root).file_count))
    return spark.createDataFrame(rows, "round string, changed bigint, deleted bigint, sections bigint, file_count bigint")


@query("server_answers", values(["asked", "results", "failed", "metadata", "performance"], [("quokka setup", 2, False, "query_processed,results_found,search_type,timestamp", "query_time,results_count,server_uptime"), ("plain words", 1, False, "query_processed,results_found,search_type,timestamp", "query_time,results_count,server_uptime"), ("error", 0, True, "error", "query_time,results_count,server_uptime")]))
def server_answers(spark, d):
    """Envelopes of answers, of an asynchronous one and of an error."""
    server, rows = serve.Server(opened(spark)), []
    answers = {"quokka setup": server.query(serve.Request("quokka setup", search_type="keyword")), "plain words": asyncio.run(server.query_async(serve.Request("plain words", search_type="keyword", format="json"))), "error": server.query(serve.Request("x", limit="no"))}
    for name, a in answers.items():
        rows.append((name, a.results_count, "error" in a.metadata, ",".join(sorted(a.metadata)), ",".join(sorted(a.performance))))
    return spark.createDataFrame(rows, "asked string, results bigint, failed boolean, metadata string, performance string")


@query("server_lifecycle", values(["step", "value"], [("health", "healthy"), ("asked", "2"), ("connections", "0"), ("names", "one,two"), ("twice", "Server already exists: one"), ("removed", "True,False"), ("after", "two"), ("shut down", "")]))
def server_lifecycle(spark, d):
    made, servers, out = opened(spark), serve.Servers(), []
    with servers.create("one", made) as one:
        out.append(("health", one.health()["status"]))
        asyncio.run(one.query_async("wombat", "c1"))
        one.reload()
        out += [("asked", str(one.stats()["total_queries"])), ("connections", str(one.stats()["active_connections"]))]
    servers.create("two", made)
    out.append(("names", ",".join(servers.names())))
    try:
        servers.create("one", made)
    except ValueError as error:
        out.append(("twice", str(error)))
    out += [("removed", f"{servers.remove('one')},{servers.remove('one')}"), ("after", ",".join(servers.names()))]
    servers.shut_down()
    return spark.createDataFrame([*out, ("shut down", ",".join(servers.names()))], "step string, value string")


@query("quick_answers", values(["way", "found"], [("quick", True), ("async", True), ("directory", True), ("manager", True)]))
def quick_answers(spark, d):
    """One-shot helpers and the shared manager."""
    made, root = opened(spark), built(spark)[0]
    found = lambda text: "quokka" in text
    rows = [("quick", found(serve.quick_query(made, "quokka setup", search_type="keyword"))), ("async", found(asyncio.run(serve.quick_query_async(made, "quokka setup", search_type="keyword")))), ("directory", found(cli.query_directory(root, "quokka setup", spark, search_type="keyword"))), ("manager", serve.shared_servers() is serve.shared_servers())]
    return spark.createDataFrame(rows, "way string, found boolean")


@query("result_cache", values(["hits", "misses", "hit_rate", "size", "max_size", "keys"], [(2, 4, 1 / 3, 2, 2, "c,a")]))
def result_cache(spark, d):
    """The oldest entry goes first, however often it is read."""
    cache = serve.FirstInCache(2)
    for key in ("a", "a", "b", "a", "c", "a"):
        cache.get(key, lambda k=key: k.upper())
    s = cache.stats()
    return spark.createDataFrame([(s["hits"], s["misses"], s["hit_rate"], s["size"], s["max_size"], ",".join(cache.rows))], "hits bigint, misses bigint, hit_rate double, size bigint, max_size bigint, keys string")


@query("tool_search", values(["asked", "processed", "n", "title", "section_type", "score", "extra"], [("show me quokka setup", "quokka setup", 2, "Setup", "document", None, ""), ("wombat code", "wombat code", 3, "Animal", "code", None, ""), ("zzzzz", "zzzzz", 0, None, None, None, "message,suggestions"), ("in one", "quokka setup", 1, "Search results in zoo", "mixed", 0.7, ""), ("absent", None, 0, None, None, None, "error")]))
def tool_search(spark, d):
    """The search tool over all workspaces, by type, without results, in one workspace (whose context is the result), and in one that is not there."""
    root, reg = built(spark)
    tools = serve.Tools(reg)
    calls = [("show me quokka setup", {}), ("wombat code", {"search_type": "code"}), ("zzzzz", {}), ("in one", {"query": "quokka setup", "workspace_id": reg.find(root).id}), ("absent", {"workspace_id": "none"})]
    rows = []
    for name, options in calls:
        out = json.loads(tools.search_workspaces(**({"query": name} | options)))
        found = out.get("results", [])
        first = found[0] if found else {}
        mixed = first.get("section_type") == "mixed"
        rows.append((name, out.get("processed_query"), len(found), first.get("title"), first.get("section_type"), first["relevance_score"] if mixed else None, ",".join(k for k in ("error", "message", "suggestions") if k in out)))
    kept = len(tools.engines)
    assert kept == 1 and tools.engine(reg.find(root).id) is tools.engine(reg.find(root).id)
    return spark.createDataFrame(rows, "asked string, processed string, n bigint, title string, section_type string, score double, extra string")


@query("tool_files", values(["asked", "content", "error"], [("web/app.js", "export function start(a, b) {\n}", False), ("lines", '    """Greets a wombat."""', False), ("function", 'def hello(name, *, loud=False):\n    """Greets a wombat."""\n    return name  # TODO later\n', False), ("absolute", "x = 1\n", False), ("../outside", None, True), ("/etc/hostname", None, True), ("absent.py", None, True), ("no function", None, True)]))
def tool_files(spark, d):
    """Paths are resolved inside registered workspaces alone."""
    root, reg = built(spark)
    tools, key = serve.Tools(reg), reg.find(root).id
    calls = {
        "web/app.js": tools.file_content("web/app.js", key, 1, 2),
        "lines": tools.file_content("src/code.py", key, 9, 9),
        "function": tools.function_content("src/code.py", "hello", key),
        "absolute": tools.file_content(f"{root}/setup.py"),
        "../outside": tools.file_content("../outside", key),
        "/etc/hostname": tools.file_content("/etc/hostname", key),
        "absent.py": tools.file_content("absent.py", key),
        "no function": tools.function_content("src/code.py", "absent", key),
    }
    rows = [(k, json.loads(v).get("content"), "error" in json.loads(v)) for k, v in calls.items()]
    return spark.createDataFrame(rows, "asked string, content string, error boolean")


@query("tool_messages", values(["asked", "outcome"], [("initialize", "quillmark"), ("tools/list", ",".join(K.TOOLS)), ("list_workspaces", "1"), ("get_workspace_info", "zoo"), ("unknown tool", "Unknown tool: none"), ("wrong argument", "Wrong arguments of list_workspaces: x"), ("unknown method", "Method not found: none"), ("notification", "no answer")]))
def tool_messages(spark, d):
    """The tools as a client of the message protocol meets them."""
    root, reg = built(spark)
    tools = serve.Tools(reg)
    ask = lambda method, **params: stdio.answer(tools, {"jsonrpc": "2.0", "id": 1, "method": method, "params": params})
    call = lambda name, **arguments: json.loads(ask("tools/call", name=name, arguments=arguments)["result"]["content"][0]["text"])
    rows = [
        ("initialize", ask("initialize")["result"]["serverInfo"]["name"]),
        ("tools/list", ",".join(t["name"] for t in ask("tools/list")["result"]["tools"])),
        ("list_workspaces", str(call("list_workspaces")["total_workspaces"])),
        ("get_workspace_info", call("get_workspace_info", workspace_id=reg.find(root).id, include_files=True)["name"]),
        ("unknown tool", call("none")["error"]),
        ("wrong argument", call("list_workspaces", x=1)["error"]),
        ("unknown method", ask("none")["error"]["message"]),
        ("notification", "no answer" if stdio.answer(tools, {"method": "notifications/initialized"}) is None else "answer"),
    ]
    return spark.createDataFrame(rows, "asked string, outcome string")


@query("cli_arguments", values(["name", "value"], [("path", '"/data"'), ("query", "null"), ("force", "true"), ("config", "null"), ("verbose", "false"), ("no_embeddings", "true"), ("parallel_workers", "4"), ("log_file", "null"), ("ask", "false"), ("workspace_name", '"w"'), ("workspace_description", '""'), ("registry", '"/r"'), ("no_central_registry", "false")]))
def cli_arguments(spark, d):
    args = cli.parser().parse_args("/data --force --no-embeddings --parallel-workers 4 --workspace-name w --registry /r".split())
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in vars(args).items()], "name string, value string")


@query("cli_prompts", values(["prompt", "answer"], [("given", "name"), ("default", "folder"), ("again", "third")]))
def cli_prompts(spark, d):
    """An answer, an empty one with a default, and one asked for until it is not empty."""
    typed = iter(["name", "", "", " ", "third"])
    read = lambda _: next(typed)
    return spark.createDataFrame([("given", cli.asked("", "folder", read)), ("default", cli.asked("", "folder", read)), ("again", cli.asked("", "", read))], "prompt string, answer string")


@query("version_info", values(["name", "version"], [("quillmark", cli.package_info()["version"])]))
def version_info(spark, d):
    info = cli.package_info()
    return spark.createDataFrame([(info["name"], info["version"])], "name string, version string")


@query("log_records", values(["level", "message"], [("INFO", "shown"), ("WARNING", "no log file at /proc/none/x.log")]))
def log_records(spark, d):
    """What the log holds at level INFO: a debug message is left out, and a file that cannot be opened is a warning."""
    import logging

    held = []
    keep = logging.Handler()
    keep.emit = held.append
    before = settings.log.handlers, settings.log.level, settings.log.propagate
    try:
        settings.configure_logging("INFO")
        settings.log.handlers, settings.log.propagate = [keep], False
        settings.log.debug("hidden")
        settings.log.info("shown")
        settings.add_log_file("/proc/none/x.log")
    finally:
        settings.log.handlers, settings.log.level, settings.log.propagate = before
    return spark.createDataFrame([(r.levelname, r.getMessage().split(":")[0]) for r in held], "level string, message string")
