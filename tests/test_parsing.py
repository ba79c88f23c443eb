import ast
import random

from quillmark.operators import classify, parsing
from quillmark.plans import corpus


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content string")


def test_markdown_edges(spark):
    text = "preamble\n  # One \n####### no\n#x\n### Three\n```\n# fenced\n```\n## Two\nend"
    rows = parsing.markdown_sections(files(spark, ("d/a.md", text), ("e/a.md", "# X"), ("f.md", "none"), ("g.md", ""))).orderBy("file_path", "start_line").collect()
    a = [(r.title, r.level, r.start_line, r.end_line, r.parent_id) for r in rows if r.file_path == "d/a.md"]
    one, fenced = "d/a.md#a_2_1", "d/a.md#a_7_1"
    assert a == [("One", 1, 2, 4, None), ("Three", 3, 5, 6, one), ("fenced", 1, 7, 8, None), ("Two", 2, 9, 10, fenced)]
    assert rows[0].children == ["d/a.md#a_5_3"] and rows[0].content == "  # One \n####### no\n#x"
    assert [r.section_id for r in rows if r.file_path == "e/a.md"] == ["e/a.md#a_1_1"] and len(rows) == 5


def test_skipped_levels(spark):
    rows = parsing.markdown_sections(files(spark, ("a.md", "# a\n### b\n## c"))).orderBy("start_line").collect()
    assert [r.parent_id for r in rows] == [None, "a.md#a_1_1", "a.md#a_1_1"]
    assert rows[0].children == ["a.md#a_2_3", "a.md#a_3_2"]


def test_hierarchy_equals_a_search_over_all_headers(spark):
    rng = random.Random(2)
    texts = {f"{i}.md": "\n".join("#" * rng.randint(1, 6) + " h" if rng.random() < 0.6 else "x" for _ in range(rng.randint(0, 40))) for i in range(40)}
    texts["many.md"] = "\n".join("#" * (1 + i % 6) + " h" for i in range(3000))
    rows = {r.section_id: r for r in parsing.markdown_sections(files(spark, *texts.items())).collect()}
    for path, text in texts.items():
        heads = [(i + 1, len(x) - 2) for i, x in enumerate(text.split("\n")) if x[:1] == "#"]
        ids = [f"{path}#{path[:-3]}_{line}_{level}" for line, level in heads]
        ups = [next((ids[j] for j in range(i - 1, -1, -1) if heads[j][1] < heads[i][1]), None) for i in range(len(heads))]
        assert [rows[x].parent_id for x in ids] == ups
        children = {}
        for x, up in zip(ids, ups, strict=True):
            children.setdefault(up, []).append(x)
        assert all(rows.pop(x).children == children.get(x, []) for x in ids)
    assert not rows


def test_rst_edges(spark):
    text = 'Top\n===\nbody\nShort title\n==\nSub\n---\n---\nx\nLast\n""""'
    rows = parsing.rst_sections(files(spark, ("a.rst", text), ("b.rst", "T\n="), ("c.rst", "=\nx"))).orderBy("start_line").collect()
    assert [(r.title, r.level, r.start_line, r.end_line) for r in rows] == [("Top", 1, 1, 5), ("Sub", 2, 6, 6), ("---", 2, 7, 11)]


def test_python_symbols_by_tree(spark):
    source = 'import os, sys\nfrom . import x\nclass A(B):\n    """Doc."""\n    async def m(self, /, a, *b, k=1, **c):\n        pass\ndef f():\n    def g(): pass\n'
    rows = parsing.python_symbols(files(spark, ("a.py", source), ("bad.py", "def broken(x):\n  class C(D):\nasync def y(a):"), ("empty.py", ""))).collect()
    a = [(r.name, r.type, r.line_number, r.column, r.signature, r.docstring) for r in rows if r.file_path == "a.py"]
    assert a == [("os", "import", 1, 0, "import os", None), ("x", "import", 2, 0, "from  import x", None), ("A", "class", 3, 0, "class A:", "Doc."), ("f", "function", 7, 0, "def f():", None), ("m", "async_function", 5, 4, "async def m(a, k, *b, **c):", None), ("g", "function", 8, 4, "def g():", None)]
    bad = [(r.name, r.type, r.line_number, r.column) for r in rows if r.file_path == "bad.py"]
    assert bad == [("broken", "function", 1, 0), ("C", "class", 2, 0), ("y", "async_function", 3, 0)]


def test_tree_symbols_of_the_corpus(spark, tmp_path):
    spark.createDataFrame([(i, i % 7) for i in range(1, 60)], "p_partkey bigint, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    sources = {r.path: r.content for r in corpus.code_files(spark, str(tmp_path)).collect() if r.path.endswith(".py")}
    got = parsing.python_symbols(corpus.code_files(spark, str(tmp_path)).filter("path LIKE '%.py'")).collect()
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Import, ast.ImportFrom)
    assert len(got) == sum(isinstance(n, kinds) for s in sources.values() for n in ast.walk(ast.parse(s))) > 50
    by_line = parsing.python_symbols_by_line(files(spark, *sources.items())).collect()
    assert {(r.file_path, r.name, r.line_number) for r in by_line} == {(r.file_path, r.name, r.line_number) for r in got if r.type != "import"}


def test_javascript(spark):
    source = "export async function a(x, y) {\nexport const no = () => 1\nlet b = async (z) => z\nvar c = d => d\nexport class E extends F {\nclass G"
    rows = parsing.javascript_symbols(files(spark, ("a.ts", source))).collect()
    assert [(r.name, r.type, r.line_number, r.signature) for r in rows] == [("a", "function", 1, "function a(x, y)"), ("b", "function", 3, "const b = () => {}"), ("E", "class", 5, "class E"), ("G", "class", 6, "class G")]


def test_outlines(spark):
    py = "class A(B):  # TODO\nasync def no(): pass\n  def f(x):\ndef broken"
    js = "const f = (a) => 1\nclass C{\nfunction g(x) {\nlet h = y => z"
    md = "######## Deep\ntext FIXME"
    rows = parsing.outlines(files(spark, ("a.py", py), ("b.js", js), ("c.md", md), ("d.txt", "TODO\n" * 60))).orderBy("file_path", "n").collect()
    of = lambda p: [(r.type, r.name, r.level, r.line) for r in rows if r.file_path == p]
    assert of("a.py") == [("class", "A", None, 1), ("todo", "class A(B):  # TODO", None, 1), ("function", "f", None, 3)]
    assert of("b.js") == [("function", "f", None, 1), ("class", "C", None, 2), ("function", "g", None, 3)]
    assert of("c.md") == [("header", "Deep", 8, 1), ("todo", "text FIXME", None, 2)] and len(of("d.txt")) == 50


def test_function_body(spark):
    py = "x = 1\n  def f(a):\n    y\n\n    def inner():\n  def g():\n    z\nlast"
    r = parsing.function_body(files(spark, ("a.py", py), ("b.py", "none")), "f").collect()
    assert [(x.file_path, x.start_line, x.end_line) for x in r] == [("a.py", 2, 5)]
    assert parsing.function_body(files(spark, ("a.py", py)), "g").first().content == "  def g():\n    z\nlast"


def test_line_slice(spark):
    df = files(spark, ("a", "1 \n2\n3\n4"), ("long", "x\n" * 600))
    got = lambda *a: {r.file_path: (r.content, r.total_lines, r.truncated) for r in parsing.line_slice(df, *a).collect()}
    assert got(2, 3)["a"] == ("2\n3", 4, False) and got(0, 1)["a"][0] == "1" and got(3)["a"][0] == "3\n4" and got(9, 2)["a"][0] == ""
    assert got()["a"] == ("1\n2\n3\n4", 4, False) and got()["long"][1:] == (601, True) and got()["long"][0].count("\n") == 499


def test_ignored(spark):
    rows = [("src/a.py", 1, False), ("build/a.py", 1, True), ("a/build", 1, True), ("rebuild/a", 1, False), ("x.pyc", 1, True), ("a.py", 6 << 20, True), (".hidden", 1, True), (".env", 1, False), ("x/.notes.md", 1, False), ("my_gradlew_x", 1, True), (None, 1, True), ("a", None, True)]
    got = spark.createDataFrame(rows, "p string, s bigint, want boolean").select(classify.ignored("p", "s").alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_types(spark):
    rows = [("a.json", "config", "configuration"), ("a.MD", "documents", "documentation"), ("Dockerfile", "unknown", "unknown"), ("a.csv", "data", "unknown"), ("a.ipynb", "notebooks", "unknown"), ("a.kt", "code", "code")]
    from quillmark.functions import text as T

    got = spark.createDataFrame(rows, "p string, a string, b string").select(classify.file_type("p"), classify.tool_file_type(T.suffix("p")), "a", "b").collect()
    assert all(r[0] == r[2] and r[1] == r[3] for r in got)
    parsers = spark.createDataFrame([("a.md",), ("b.tsx",), ("c.java",), ("d.rst",), ("e.pyi",)], "p string").select(parsing.parser_of("p")).collect()
    assert [r[0] for r in parsers] == ["markdown", "javascript", None, "rst", "python"]


def test_tags_and_settings(spark):
    df = spark.createDataFrame([("python", ["docs/a", "tests/b"]), ("go", ["x/api/y"])], "k string, p array<string>")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(classify.tags(F.col("k"), F.col("p"))).collect()] == [["python", "documentation", "testing"], ["go"]]
    assert classify.language_settings("documentation")["indexing"]["chunk_size"] == 256 and classify.language_settings("x") == {}


def test_own_parser_and_table_function(spark, monkeypatch):
    monkeypatch.setattr(parsing, "PARSERS", list(parsing.PARSERS))
    parsing.add_parser(parsing.Parser("notes", (".note",), parsing.markdown_sections, "sections"))
    df = files(spark, ("a.note", "# N"), ("b.md", "# M"), ("c.py", "def f(): pass"))
    assert sorted(r.title for r in parsing.parsed_sections(df).collect()) == ["M", "N"]
    assert [r.name for r in parsing.parsed_symbols(df).collect()] == ["f"]
    parsing.register_table_functions(spark)
    df.createOrReplaceTempView("some_files")
    rows = spark.sql("SELECT s.name, s.line_number FROM some_files, LATERAL python_symbols(path, content) s WHERE path LIKE '%.py'").collect()
    assert [tuple(r) for r in rows] == [("f", 1)]
    import pytest

    with pytest.raises(ValueError):
        parsing.add_parser(parsing.Parser("x", (), parsing.markdown_sections, "words"))
