import asyncio
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillmark import cli, settings, workspace
from quillmark.operators import embedding, registry
from quillmark.operators import search as search_ops
from quillmark.serve import FirstInCache, Request, Server, Servers, Tools, quick_query
from quillmark.sources import files as sources
from quillmark.streaming import ingest


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "project"
    (root / "docs").mkdir(parents=True)
    (root / "build").mkdir()
    (root / "docs" / "guide.md").write_bytes("# Guide\r\nInstall the quokka service.\r\n## Setup\r\nRun quokka setup now. Then stop.\r\n".encode())
    (root / "docs" / "other.md").write_text("# Other\nNothing of note here at all.\n# Third\nMore plain words.\n# Fourth\nStill more of them.\n")
    (root / "code.py").write_text('def hello(name):\n    """Greets a wombat."""\n    return name  # TODO\n')
    (root / "latin +1.txt").write_bytes("caf\xe9".encode("latin-1"))
    (root / "setup.py").write_text("x = 1\n")
    (root / "build" / "out.md").write_text("# Ignored")
    return root


def test_scan(spark, project):
    rows = {r.path: r for r in sources.scan(spark, str(project)).collect()}
    assert set(rows) == {"docs/guide.md", "docs/other.md", "code.py", "latin +1.txt", "setup.py"}
    assert rows["latin +1.txt"].content == "café" and rows["latin +1.txt"].encoding == "latin-1"
    assert "\r" not in rows["docs/guide.md"].content and rows["code.py"].file_type == "code"
    assert abs(rows["code.py"].modified - (project / "code.py").stat().st_mtime) < 1


def test_build_query_update(spark, project, tmp_path):
    reg = registry.Registry(spark, f"{tmp_path}/registry")
    made = workspace.build(spark, str(project), registry=reg, name="proj", description="d")
    assert made["file_count"] == 5 and made["document_count"] == 5 and made["code_symbol_count"] == 1 and made["embedding_count"] == 6
    row = reg.get(made["workspace_id"])
    assert row.project_type == "python" and row.tags == ["python", "documentation"] and row.document_count == 5
    opened = workspace.Workspace(spark, f"{project}/.quillmark")
    assert {r.budget for r in opened.table("chunks").select("budget").distinct().collect()} == {1000, 2000, 4000, 8000}
    with Server(opened) as server:
        text = server.query(Request("quokka setup", search_type="keyword"))
        assert text.results_count >= 1 and "quokka" in text.content and "*Source: docs/guide.md*" in text.content
        assert json.loads(server.query(Request("quokka", format="json", search_type="keyword")).content)[0]["match_type"] == "keyword"
        assert "### Result 1:" in server.query(Request("quokka setup", format="structured")).content
        server.query(Request("quokka setup", search_type="keyword"))
        assert server.cache.hits == 1 and server.stats()["total_queries"] == 4 and server.health()["status"] == "healthy"
        assert server.query(Request("how is the", search_type="keyword")).content == "No relevant content found for your query."
        assert asyncio.run(server.query_async("quokka")).results_count >= 1
        assert "## " in server.context("quokka setup")
        bad = server.query(Request("x", format="json", limit="no"))
        assert bad.results_count == 0 and "error" in bad.metadata
    assert "quokka" in quick_query(opened, "quokka setup") and "quokka" in cli.query_directory(str(project), "quokka setup", spark)
    assert "w_postings" in opened.create_views("w_")
    assert spark.sql("SELECT count(*) AS n FROM w_sections WHERE level = 1").first().n == 4
    assert workspace.update(spark, str(project)) == {"changed": 0, "deleted": 0}
    (project / "code.py").unlink()
    (project / "new.md").write_text("# New\nA numbat lives here.")
    assert workspace.update(spark, str(project)) == {"changed": 1, "deleted": 1}
    assert opened.table("symbols").count() == 0 and opened.table("sections").filter("file_path = 'new.md'").count() == 1


def test_tools(spark, project, tmp_path):
    reg = registry.Registry(spark, f"{tmp_path}/registry")
    key = workspace.build(spark, str(project), registry=reg, name="proj")["workspace_id"]
    tools = Tools(reg)
    found = json.loads(tools.search_workspaces("show me quokka setup"))
    assert found["processed_query"] == "quokka setup" and found["results"][0]["workspace_path"] == str(project)
    code = json.loads(tools.search_workspaces("wombat", search_type="code"))["results"]
    assert [r["title"] for r in code] == ["hello"] and code[0]["content_preview"].startswith("function hello(def hello(name):) - Greets")
    alone = json.loads(tools.search_workspaces("quokka setup", key))
    assert alone["results"][0]["section_type"] == "mixed" and alone["results"][0]["relevance_score"] == 0.7
    assert "suggestions" in json.loads(tools.search_workspaces("zzzzz")) and "error" in json.loads(tools.search_workspaces("x", "none"))
    assert json.loads(tools.list_workspaces())["registry_stats"]["total_workspaces"] == 1
    assert json.loads(tools.workspace_info(key, True))["files"][0] == "code.py"
    got = json.loads(tools.file_content("code.py", key, 1, 1))
    assert got["content"] == "def hello(name):" and [o["type"] for o in got["outline"]] == ["function", "todo"]
    assert json.loads(tools.function_content("code.py", "hello", key))["start_line"] == 1
    (tmp_path / "secret.txt").write_text("s")
    for path in ("../secret.txt", f"{tmp_path}/secret.txt", "absent.py"):
        assert "error" in json.loads(tools.file_content(path, key))


def test_empty_directory(spark, tmp_path):
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.log").write_text("x")
    assert workspace.build(spark, f"{tmp_path}/none")["file_count"] == 0


def test_cli(spark, project, capsys):
    assert cli.main([str(project), "--no-embeddings"]) == 0
    assert cli.main([str(project)]) == 1 and cli.main([str(project), "--query", "quokka setup"]) == 0
    assert "quokka" in capsys.readouterr().out
    assert not embedding.exists(spark, f"{project}/.quillmark/vectors")
    with pytest.raises(FileNotFoundError):
        cli.open_directory(f"{project}/docs", spark)


def test_registry_rules(spark, tmp_path):
    reg = registry.Registry(spark, f"{tmp_path}/r", max_workspaces=2, backups=3)
    assert reg.workspaces().count() == 0 and reg.stats().first().health_status == "healthy"
    a, b = reg.register("/a", "A", "x", tags=["t"]), reg.register("/b", "B", "y")
    with pytest.raises(ValueError):
        reg.register("/a", "A", "again")
    with pytest.raises(ValueError):
        reg.register("/c", "C", "too many")
    reg.update_stats(a, document_count=5, health_score=0.5)
    reg.relate(a, b, "imports")
    reg.relate(a, b, "imports")
    assert [(r.dst, r.name, r.types) for r in reg.related(a).collect()] == [(b, "B", ["imports"])]
    for wrong in ((a, b, "likes"), (a, "zz", "imports"), ("zz", a, "imports")):
        with pytest.raises(ValueError):
            reg.relate(*wrong)
    made = reg.get(a).created_at
    assert reg.register("/a", "A2", "forced", force=True) == a
    assert reg.get(a).created_at == made and reg.get(a).document_count == 0 and reg.related(a).count() == 0
    fact = spark.createDataFrame([("n", "s", "term", "p", "f.md", "document", ["k"])], "workspace_name string, section_id string, title string, content_preview string, file_path string, section_type string, keywords array<string>")
    reg.update_facts(a, fact)
    reg.update_facts(b, fact)
    reg.update_facts(a, fact.unionByName(fact))
    assert reg.search("term").count() == 3
    reg.update_facts(a, fact.limit(0))
    assert reg.search("term").count() == 1
    reg.remove(b)
    assert reg.search("term").count() == 0 and reg.get(b) is None and len(reg._snapshots("workspaces")) <= 4
    reg._write("workspaces", reg.workspaces(True).withColumn("status", F.lit("inactive")))
    assert reg.clean_up(datetime(2000, 1, 1)) == [] and reg.clean_up(datetime(2100, 1, 1)) == [a]
    assert registry.shared_registry(spark, "x") is registry.shared_registry(spark, "x")
    registry.reset_shared_registry()


def test_settings(tmp_path):
    path = tmp_path / "c" / "config.json"
    mine = settings.Settings()
    mine.update(max_results=7, nonsense=1)
    settings.save(mine, path)
    assert settings.load(path).search.max_results == 7
    path.write_text('{"search": {"max_results": 3, "fuzzy": 1}}')
    assert settings.load(path).search.max_results == 3
    for broken in ("{", "[]", '{"search": 3}'):
        path.write_text(broken)
        assert settings.load(path) == settings.Settings()
    assert settings.load(tmp_path / "absent") == settings.Settings()


def test_cache_is_first_in_first_out():
    cache = FirstInCache(2)
    for key in "abaca":
        cache.get(key, lambda key=key: key)
    assert list(cache.rows) == ["c", "a"] and cache.stats()["hits"] == 1 and FirstInCache().stats()["hit_rate"] == 0.0


def test_servers(spark, project):
    workspace.build(spark, str(project), settings=settings.Settings(indexing=settings.Indexing(enable_embeddings=False)))
    opened, servers = workspace.Workspace(spark, f"{project}/.quillmark"), Servers()
    servers.create("one", opened)
    with pytest.raises(ValueError):
        servers.create("one", opened)
    assert servers.names() == ["one"] and servers.get("two") is None and "one" in servers.stats()
    assert servers.remove("one") and not servers.remove("one")
    with pytest.raises(FileNotFoundError):
        Server(workspace.Workspace(spark, f"{project}/absent"))


def test_encoder_and_embedding_tables(spark, tmp_path):
    chunks = spark.createDataFrame([("document", "s", "s_0", "alpha beta"), ("code", "c", "c", "beta alpha"), ("code", "e", "e", "")], "kind string, section_id string, chunk_id string, chunk string")
    embedding.write(embedding.encoded(chunks), f"{tmp_path}/v")
    rows = {r.section_id: r for r in embedding.load(spark, f"{tmp_path}/v").collect()}
    assert rows["s"].embedding == rows["c"].embedding and abs(sum(x * x for x in rows["s"].embedding) - 1) < 1e-5 and not any(rows["e"].embedding)
    assert {(r.kind, r.total, r.dimension) for r in embedding.stats(embedding.load(spark, f"{tmp_path}/v")).collect()} == {("document", 1, 64), ("code", 2, 64)}


def test_stream_of_sections_builds_the_same_index(spark, tmp_path):
    kind = "section_id string, title string, content string, file_path string"
    rows = [(str(i), f"t{i}", f"word{i % 3} common text{i}", "f") for i in range(12)]
    df = spark.createDataFrame(rows, kind)
    for part in range(3):
        df.filter(F.col("section_id") % 3 == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        ingest.index_stream(ingest.read_sections(spark, f"{tmp_path}/in", df.schema, 1), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    from quillmark.operators import index

    streamed, whole = ingest.load_index(spark, f"{tmp_path}/out"), index.build(df)
    both = [sorted((r.section_id, round(r.score, 9)) for r in search_ops.bm25(i, ["word1", "text4"]).collect()) for i in (streamed, whole)]
    assert both[0] == both[1] and both[0]


def test_query_log_stream(spark, tmp_path):
    log = spark.createDataFrame([("2024-01-01 00:10:00", "ok", 1.0), ("2024-01-01 00:20:00", "ok", 3.0), ("2024-01-01 05:00:00", "ok", 1.0)], "ts string, outcome string, seconds double").withColumn("ts", F.to_timestamp("ts"))
    log.coalesce(1).write.parquet(f"{tmp_path}/log")
    stream = ingest.query_log_windows(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log"))
    q = stream.writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.queries, r.mean_seconds) for r in spark.sql("SELECT * FROM windows").collect()] == [(2, 2.0)]


def test_versions_of_embeddings(spark, tmp_path):
    rows = embedding.encoded(spark.createDataFrame([("code", "s", "c", "x")], "kind string, section_id string, chunk_id string, chunk string"))
    made = [embedding.write_version(rows, f"{tmp_path}/v", keep=2) for _ in range(4)]
    assert embedding.versions(spark, f"{tmp_path}/v") == made[-2:] and embedding.load(spark, made[-1], "code").count() == 1


def test_prompts_and_log_files(tmp_path, capsys):
    answers = iter(["", "  ", "a name"])
    assert cli.asked("?", read=lambda _: next(answers)) == "a name" and cli.asked("?", "d", lambda _: "") == "d"
    settings.configure_logging("INFO", tmp_path / "logs" / "x.log")
    settings.log.info("hello")
    assert "hello" in (tmp_path / "logs" / "x.log").read_text()
    (tmp_path / "plain").write_text("")
    settings.configure_logging("INFO", tmp_path / "plain" / "x.log")
    settings.configure_logging()
    assert cli.package_info()["version"]


def test_messages_over_lines(spark, project, tmp_path):
    import io

    from quillmark import stdio

    reg = registry.Registry(spark, f"{tmp_path}/registry")
    workspace.build(spark, str(project), registry=reg, name="proj")
    lines = ['{"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {"protocolVersion": "2024-11-05"}}', "", '{"jsonrpc": "2.0", "method": "notifications/initialized"}', "{", "[]", '{"jsonrpc": "2.0", "id": "x", "method": "tools/call", "params": {"name": "search_workspaces", "arguments": {"query": "quokka setup"}}}']
    out = io.StringIO()
    stdio.serve(Tools(reg), io.StringIO("\n".join(lines)), out)
    answers = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [a["id"] for a in answers] == [1, None, None, "x"] and answers[1]["error"]["code"] == -32700 and answers[2]["error"]["code"] == -32600
    assert json.loads(answers[3]["result"]["content"][0]["text"])["results"][0]["workspace_name"] == "proj" and not answers[3]["result"]["isError"]


def test_encodings(spark):
    texts = {"é": "utf-8", "caf\xe9": "latin-1", "“5 €”": "cp1252", "plain": "utf-8"}
    rows = [(t, bytearray(t.encode(e))) for t, e in texts.items()] + [("\x81\x80", bytearray(b"\x81\x80"))]
    text, encoding = sources.decoded("raw")
    got = {r.want: (r.text, r.encoding) for r in spark.createDataFrame(rows, "want string, raw binary").select("want", text.alias("text"), encoding.alias("encoding")).collect()}
    assert got == {t: (t, e) for t, e in texts.items()} | {"\x81\x80": ("\x81\x80", "latin-1")}
