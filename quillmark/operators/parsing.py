"""Files to sections, symbols, outlines and slices.

Sections and regex symbols are array expressions over one file's row, so parsing needs no shuffle; Python syntax trees take an Arrow pass.
files: path, content.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import constants as K
from quillmark.functions import text as T

SECTION = "section_id string, title string, level int, start_line int, end_line int, content string, parent_id string, children array<string>, file_path string"
SYMBOL = "name string, type string, file_path string, line_number int, column int, scope string, signature string, docstring string"


def _lines() -> Column:
    return F.split("content", "\n")


def _nearest(levels: Column, reach: int) -> Column:
    """For each of some header levels the place, from 0 on, of the last one before it of a level up to its own plus `reach`; -1 without one."""
    none = F.struct(F.array_repeat(F.lit(-1), 6).alias("last"), F.array().cast("array<int>").alias("out"))
    seen = lambda got, x: F.transform(got["last"], lambda at, k: F.when(k + 1 == x, F.size(got["out"])).otherwise(at))
    found = lambda got, x: F.coalesce(F.array_max(F.slice(got["last"], 1, x + reach)), F.lit(-1))
    return F.aggregate(levels, none, lambda got, x: F.struct(seen(got, x).alias("last"), F.concat(got["out"], F.array(found(got, x))).alias("out")), lambda got: got["out"])


def markdown_sections(files: DataFrame) -> DataFrame:
    """SECTION rows: a header's lines up to the next header; text before the first belongs to none; headers inside code fences count.

    The parent is the nearest earlier header of a smaller level, within the file; ids hold the whole path, so equal names in two folders differ. Sections are
    cut before they become rows, so that no row carries its file; a header's children are sought below it alone, which each of the six levels reads once.
    """
    lines = files.select("path", "content", F.transform(_lines(), T.strip).alias("stripped"))
    marked = F.filter(F.transform("stripped", lambda x, i: F.struct((i + 1).alias("line"), F.length(F.regexp_extract(x, K.HEADER, 1)).alias("level"), T.strip(F.regexp_extract(x, K.HEADER, 2)).alias("title"))), lambda h: h["level"] > 0)
    heads = lines.select("path", _lines().alias("lines"), marked.alias("heads"))
    levels = F.transform("heads", lambda h: h["level"])
    # Zipped, as a column that a lambda names once would be worked out for each element.
    name = lambda h: F.concat_ws("#", "path", F.concat_ws("_", T.stem("path"), h["line"], h["level"]))
    ends = F.zip_with("heads", F.reverse(_nearest(F.reverse(levels), 0)), lambda h, end: F.struct(h["line"].alias("line"), h["level"].alias("level"), h["title"].alias("title"), name(h).alias("id"), end.alias("end")))
    named = heads.select("path", "lines", F.zip_with(ends, _nearest(levels, -1), lambda h, up: F.struct(h["line"].alias("line"), h["level"].alias("level"), h["title"].alias("title"), h["id"].alias("id"), h["end"].alias("end"), up.alias("up"))).alias("heads"))

    def section(h: Column, i: Column) -> Column:
        stop = F.coalesce(F.get("heads", i + 1)["line"] - 1, F.size("lines"))
        below = F.slice("heads", i + 2, F.size("heads") - 2 - h["end"] - i)
        return F.struct(
            h["id"].alias("section_id"), h["title"].alias("title"), h["level"].alias("level"), h["line"].alias("start_line"), stop.alias("end_line"),
            F.array_join(F.slice("lines", h["line"], stop - h["line"] + 1), "\n").alias("content"), F.get("heads", h["up"])["id"].alias("parent_id"),
            F.transform(F.filter(below, lambda o: o["up"] == i), lambda o: o["id"]).alias("children"),
        )

    each = named.select(F.col("path").alias("file_path"), F.explode_outer(F.transform("heads", section)).alias("s")).filter("s IS NOT NULL")
    return each.select("s.*", "file_path")


def rst_level(underline: Column) -> Column:
    first = F.substring(underline, 1, 1)
    return F.when(first == "=", 1).when(first == "-", 2).when(first == "^", 3).when(first == '"', 4).otherwise(5)


def rst_sections(files: DataFrame) -> DataFrame:
    """SECTION rows of underlined titles: a line of one of = - ^ " not shorter than the line above it, and not the file's last line."""
    lines = files.select("path", F.split("content", "\n").alias("lines"), F.transform(_lines(), T.strip).alias("s"))
    above = lambda i: F.try_element_at("s", i)  # noqa: E731  i counts from 0: the line before
    is_head = lambda x, i: x.rlike(r'^(=+|-+|\^+|"+)\z') & (i > 0) & (i + 1 < F.size("s"))
    fits = lambda x, i: F.when(is_head(x, i), (F.length(above(i)) > 0) & (F.length(above(i)) <= F.length(x))).otherwise(False)
    heads = F.filter(F.transform("s", lambda x, i: F.when(fits(x, i), F.struct((i + 1).alias("line"), rst_level(x).alias("level"), above(i).alias("title")))), lambda h: h.isNotNull())
    named = lines.select("path", "lines", heads.alias("heads"))

    def section(h: Column, i: Column) -> Column:
        stop = F.coalesce(F.get("heads", i + 1)["line"] - 2, F.size("lines"))
        return F.struct(
            F.concat(F.col("path"), F.lit("#"), F.concat_ws("_", T.stem("path"), h["line"], h["level"])).alias("section_id"), h["title"].alias("title"), h["level"].alias("level"),
            (h["line"] - 1).alias("start_line"), stop.alias("end_line"), F.array_join(F.slice("lines", h["line"] - 1, F.greatest(F.lit(0), stop - h["line"] + 2)), "\n").alias("content"),
            F.lit(None).cast("string").alias("parent_id"), T.strings([]).alias("children"),
        )

    each = named.select(F.col("path").alias("file_path"), F.explode_outer(F.transform("heads", section)).alias("s")).filter("s IS NOT NULL")
    return each.select("s.*", "file_path")


def _symbol(line: Column, kind, name: Column, signature: Column) -> Column:
    return F.struct(name.alias("name"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), line.alias("line_number"), signature.alias("signature"))


def _by_line(files: DataFrame, rules) -> DataFrame:
    """SYMBOL rows from what `rules(line, number)` finds in each line: an array of nullable structs."""
    found = F.flatten(F.transform(_lines(), lambda x, i: F.filter(rules(x, i + 1), lambda s: s.isNotNull())))
    each = files.select(F.col("path").alias("file_path"), F.explode(found).alias("s"))
    return each.select("s.name", "s.type", "file_path", "s.line_number", F.lit(0).alias("column"), F.lit("global").alias("scope"), "s.signature", F.lit(None).cast("string").alias("docstring"))




def python_symbols_by_line(files: DataFrame) -> DataFrame:
    """Definitions by line patterns, for sources that do not parse."""

    def rules(x: Column, n: Column) -> Column:
        is_async = F.regexp_extract(x, K.PY_DEF, 1) != ""
        name, parameters, cls = F.regexp_extract(x, K.PY_DEF, 2), F.regexp_extract(x, K.PY_DEF, 3), F.regexp_extract(x, K.PY_CLASS, 1)
        signature = F.concat(F.when(is_async, "async ").otherwise(""), F.lit("def "), name, F.lit("("), parameters, F.lit("):"))
        return F.array(
            F.when(name != "", _symbol(n, F.when(is_async, "async_function").otherwise("function"), name, signature)),
            F.when(cls != "", _symbol(n, "class", cls, F.concat(F.lit("class "), cls, F.regexp_extract(x, K.PY_CLASS, 2), F.lit(":")))),
        )

    return _by_line(files, rules)




def javascript_symbols(files: DataFrame) -> DataFrame:
    """Functions, arrow functions with parenthesised parameters, and classes, by line."""

    def rules(x: Column, n: Column) -> Column:
        name, arrow, cls = F.regexp_extract(x, K.JS_FUNCTION, 1), F.regexp_extract(x, K.JS_ARROW, 1), F.regexp_extract(x, K.JS_CLASS, 1)
        return F.array(
            F.when(name != "", _symbol(n, "function", name, F.concat(F.lit("function "), name, F.lit("("), F.regexp_extract(x, K.JS_FUNCTION, 2), F.lit(")")))),
            F.when(arrow != "", _symbol(n, "function", arrow, F.concat(F.lit("const "), arrow, F.lit(" = () => {}")))),
            F.when(cls != "", _symbol(n, "class", cls, F.concat(F.lit("class "), cls))),
        )

    return _by_line(files, rules)


def _signature(node) -> str:
    names = [a.arg for a in [*node.args.args, *node.args.kwonlyargs]]
    names += [f"{stars}{a.arg}" for stars, a in (("*", node.args.vararg), ("**", node.args.kwarg)) if a]
    return f"{'async ' if isinstance(node, ast.AsyncFunctionDef) else ''}def {node.name}({', '.join(names)}):"


def python_symbols_of(source: str) -> list[tuple] | None:
    """(name, type, line, column, signature, docstring) in breadth-first order; None for a source that does not parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return None
    out = []
    for node in ast.walk(tree):
        match node:
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                row = (node.name, "async_function" if isinstance(node, ast.AsyncFunctionDef) else "function", _signature(node), ast.get_docstring(node))
            case ast.ClassDef():
                row = (node.name, "class", f"class {node.name}:", ast.get_docstring(node))
            case ast.Import():
                row = (first := node.names[0].name, "import", f"import {first}", None)
            case ast.ImportFrom():
                row = (first := node.names[0].name, "import", f"from {node.module or ''} import {first}", None)
            case _:
                continue
        out.append((row[0], row[1], node.lineno, node.col_offset, row[2], row[3]))
    return out


def python_symbols(files: DataFrame) -> DataFrame:
    """SYMBOL rows of syntax trees, line patterns where a file has none; symbols of a file keep their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = python_symbols_of(source or "")
                rows += [(n, t, path, line, column, "global", s, doc) for n, t, line, column, s, doc in (found if found is not None else _fallback(source or ""))]
            kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [f.split()[0] for f in SYMBOL.split(", ")])

    return files.select("path", "content").mapInArrow(run, SYMBOL)


def _fallback(source: str) -> Iterator[tuple]:
    for n, line in enumerate(source.split("\n"), 1):
        if m := re.match(K.PY_DEF, line):
            lead = "async " if m[1] else ""
            yield m[2], "async_function" if m[1] else "function", n, 0, f"{lead}def {m[2]}({m[3]}):", None
        if m := re.match(K.PY_CLASS, line):
            yield m[1], "class", n, 0, f"class {m[1]}{m[2] or ''}:", None


@dataclass(frozen=True)
class Parser:
    """Files of some suffixes to rows: `parse` takes files(path, content) and returns SECTION or SYMBOL rows."""

    name: str
    suffixes: tuple[str, ...]
    parse: Callable[[DataFrame], DataFrame]
    makes: str


PARSERS: list[Parser] = [
    Parser("markdown", tuple(K.PARSER_SUFFIXES["markdown"]), markdown_sections, "sections"),
    Parser("rst", tuple(K.PARSER_SUFFIXES["rst"]), rst_sections, "sections"),
    Parser("python", tuple(K.PARSER_SUFFIXES["python"]), python_symbols, "symbols"),
    Parser("javascript", tuple(K.PARSER_SUFFIXES["javascript"]), javascript_symbols, "symbols"),
]


def add_parser(parser: Parser) -> None:
    """Adds a parser behind the others; the first that has a suffix takes its files."""
    if parser.makes not in ("sections", "symbols"):
        raise ValueError(f"A parser makes sections or symbols, not {parser.makes}")
    PARSERS.append(parser)


def parser_of(path: Column | str) -> Column:
    """The parser of a file's suffix; null for none."""
    out, end = F.lit(None).cast("string"), T.suffix(path)
    for parser in reversed(PARSERS):
        out = F.when(end.isin(*parser.suffixes), parser.name).otherwise(out)
    return out


def _parsed(files: DataFrame, makes: str) -> DataFrame:
    parts = [p.parse(files.filter(parser_of("path") == p.name)) for p in PARSERS if p.makes == makes]
    return reduce(DataFrame.unionByName, parts)


def parsed_sections(files: DataFrame) -> DataFrame:
    return _parsed(files, "sections")


def parsed_symbols(files: DataFrame) -> DataFrame:
    return _parsed(files, "symbols")


class PythonSymbols:
    """A table function over (path, source) for SQL: SELECT s.* FROM files, LATERAL python_symbols(path, content) s."""

    def eval(self, path: str, source: str):
        found = python_symbols_of(source or "")
        for n, t, line, column, signature, doc in found if found is not None else _fallback(source or ""):
            yield n, t, path, line, column, "global", signature, doc


def register_table_functions(spark: SparkSession) -> None:
    spark.udtf.register("python_symbols", F.udtf(PythonSymbols, returnType=SYMBOL))


def _after(x: Column, mark: str) -> Column:
    """What follows the first mark, up to a second."""
    return F.element_at(F.split(x, mark, -1), 2)


def outlines(files: DataFrame, most: int = K.OUTLINE_ITEMS) -> DataFrame:
    """file_path, type, name, level, line and content of a file's first items: definitions or headers by suffix, and TODO or FIXME lines of any file."""
    end = T.suffix("path")

    def items(x: Column, i: Column) -> Column:
        s = T.strip(x)

        def item(kind: str, name: Column, level: Column | None = None) -> Column:
            return F.struct(F.lit(kind).alias("type"), name.alias("name"), (level if level is not None else F.lit(None).cast("int")).alias("level"), (i + 1).alias("line"), s.alias("content"))

        before = lambda y, mark: F.element_at(F.split(y, mark, -1), 1)
        python = F.when(s.startswith("class ") & x.contains(":"), item("class", T.strip(before(before(_after(s, "class "), r"\("), ":")))).when(s.startswith("def ") & x.contains(":"), item("function", T.strip(before(_after(s, "def "), r"\("))))
        # A line with "function " but only outside its trimmed part cannot be named.
        js_name = (
            F.when(s.contains("function "), T.strip(before(_after(s, "function "), r"\(")))
            .when(s.contains("const ") & s.contains("=>"), T.strip(before(_after(s, "const "), "=")))
            .when(s.contains("let ") & s.contains("=>"), T.strip(before(_after(s, "let "), "=")))
            .otherwise("anonymous")
        )
        script = F.when(x.contains("function ") | (x.contains("const ") & x.contains("=>")), item("function", js_name)).when(s.startswith("class "), item("class", T.strip(before(before(_after(s, "class "), " "), r"\{"))))
        title = F.regexp_replace(s, "^#+", "")
        header = F.when(s.startswith("#"), item("header", T.strip(title), F.length(s) - F.length(title)))
        own = F.when(end == ".py", python).when(end.isin(".js", ".ts"), script).when(end.isin(".md", ".rst"), header)
        return F.array_compact(F.array(own, F.when(s.contains("TODO") | s.contains("FIXME"), item("todo", s))))

    found = F.slice(F.flatten(F.transform(_lines(), items)), 1, most)
    return files.select(F.col("path").alias("file_path"), F.posexplode(found).alias("n", "o")).select("file_path", "n", "o.*")


def function_body(files: DataFrame, name: str) -> DataFrame:
    """file_path, start_line, end_line and content of the first function of that name in each file that has one.

    It ends before the first later definition that is not indented further, else with the file.
    """
    holds = lambda x: x.contains(f"def {name}(") | x.contains(f"function {name}(") | x.contains(f"fun {name}(")
    numbered = F.transform("lines", lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    start = files.select(F.col("path").alias("file_path"), _lines().alias("lines")).withColumn("numbered", numbered).withColumn("first", F.try_element_at(F.filter("numbered", lambda r: holds(r["x"])), F.lit(1)))
    indent = lambda x: F.length(x) - F.length(F.regexp_replace(x, f"^{T.SPACE}+", ""))
    ends = lambda r: (r["i"] > F.col("first.i")) & (T.strip(r["x"]) != "") & (indent(r["x"]) <= F.col("base")) & T._any(r["x"].contains(m) for m in ("def ", "function ", "fun ", "class "))
    found = start.filter("first IS NOT NULL").withColumn("base", indent(F.col("first.x")))
    stop = F.coalesce(F.try_element_at(F.filter("numbered", ends), F.lit(1))["i"], F.size("lines"))
    return found.select("file_path", (F.col("first.i") + 1).alias("start_line"), stop.alias("end_line"), F.array_join(F.slice("lines", F.col("first.i") + 1, stop - F.col("first.i")), "\n").alias("content"))


def line_slice(files: DataFrame, start: int | None = None, end: int | None = None, most: int = K.FILE_LINES) -> DataFrame:
    """file_path, total_lines, truncated and content of the lines from start to end; without a range the first `most`."""
    first = max(0, (start or 0) - 1)
    whole = not start and not end
    rows = files.select(F.col("path").alias("file_path"), F.transform(_lines(), lambda x: F.regexp_replace(x, f"{T.SPACE}+\\z", "")).alias("lines"))
    n = F.size("lines")
    last = F.least(n, F.lit(first + most)) if whole else F.least(n, F.lit(end)) if end else n
    return rows.select("file_path", n.cast("bigint").alias("total_lines"), (F.lit(whole) & (n > most)).alias("truncated"), F.array_join(F.slice("lines", first + 1, F.greatest(F.lit(0), last - first)), "\n").alias("content"))
