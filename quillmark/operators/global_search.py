"""Search across workspaces: field-weighted substring scores over one flattened table of sections and symbols.

facts(workspace_id, workspace_name, section_id, title, content_preview, file_path, section_type, keywords). Substring rules rule out an inverted index, so a
query is one scan with its terms as constants of generated expressions: no join, no shuffle but the top-k.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import constants as K
from quillmark.functions import text as T


def terms_of(query: str) -> list[str]:
    return [t.lower() for t in query.split() if len(t) > 2]


def cleaned(query: str) -> str:
    """The query cleaner on the driver."""
    out = query.lower()
    for phrase in K.CLEANER_STOP_PHRASES:
        out = out.replace(phrase, " ")
    kept = [w for w in out.split() if len(w) > 2 and w not in K.CLEANER_STOP_WORDS]
    return " ".join(kept) if kept else query


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def term_score(term: str) -> tuple[Column, Column]:
    """(score, number of fields hit) of one term; keywords score but are no field."""
    t, title, body, path = F.lit(term), F.lower("title"), F.lower("content_preview"), F.lower("file_path")
    hits = [title.contains(t), body.contains(t), path.contains(t), F.lower("workspace_name").contains(t)]
    by_title = F.when(title == t, 15.0).when(title.startswith(t) | title.endswith(t), 12.0).otherwise(8.0)
    by_keyword = F.aggregate("keywords", F.lit(0.0), lambda s, k: s + F.when(F.lower(k) == t, 5.0).when(F.lower(k).contains(t), 3.0).otherwise(0.0))
    by_path = F.when(F.lower(T.basename("file_path")).contains(t), 3.0).otherwise(1.5)
    points = [by_title, F.least(T.occurrences(body, t) * 2.0, F.lit(6.0)), by_path, F.lit(2.0)]
    fields = [F.coalesce(h, F.lit(False)) for h in hits]
    return _sum([F.when(h, p).otherwise(0.0) for h, p in zip(fields, points, strict=True)]) + F.coalesce(by_keyword, F.lit(0.0)), reduce(lambda a, b: a + b, [h.cast("int") for h in fields])


def proximity(terms: list[str]) -> Column:
    """2 less a fiftieth of the mean gap between the terms' first places in the preview, 0 at least; the mean gap is (last - first) / (places - 1)."""
    body = F.lower("content_preview")
    places = F.filter(F.array(*(F.instr(body, t) for t in terms)), lambda p: p > 0)
    n = F.size(places)
    return F.when(n < 2, 0.0).otherwise(F.greatest(F.lit(0.0), 2.0 - (F.array_max(places) - F.array_min(places)) / (n - 1) / 50.0))


def scored(facts: DataFrame, query: str) -> DataFrame:
    """Facts that a field hit, with score: term scores, coverage, perfect-match, proximity and type bonuses."""
    terms = terms_of(query)
    if not terms:
        return facts.withColumn("score", F.lit(0.0)).filter(F.lit(False))
    by_term = [term_score(t) for t in terms]
    rows = facts.withColumn("_points", _sum([s for s, _ in by_term])).withColumn("_hits", reduce(lambda a, b: a + b, [h for _, h in by_term])).filter("_hits > 0")
    n = len(terms)
    near = F.when(F.col("_hits") > 1, proximity(terms)).otherwise(0.0) if n > 1 else F.lit(0.0)
    bonus = F.when(F.col("section_type") == "code", 1.0).when(F.col("section_type") == "documentation", 0.5).otherwise(0.0)
    total = F.col("_points") + F.col("_hits") * 5.0 / n + F.when(F.col("_hits") == n, 3.0).otherwise(0.0) + near + bonus
    return rows.withColumn("score", total).drop("_points", "_hits")


def search(facts: DataFrame, query: str, most: int = 20, kind: str = "all") -> DataFrame:
    """The best facts; a search type drops rows after the limit, so there may be fewer."""
    top = scored(facts, query).orderBy(F.desc(F.round("score", 6)), "section_id").limit(most)
    return top if kind == "all" else top.filter(T.suffix("file_path").isin(K.TYPE_SUFFIXES.get(kind, [])))


def with_workspaces(rows: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Rows with workspace_path, null for a workspace that the registry lacks."""
    return rows.join(workspaces.select(F.col("id").alias("workspace_id"), F.col("path").alias("workspace_path")), "workspace_id", "left")


def section_facts(sections: DataFrame, workspace_id: str, workspace_name: str, keywords: DataFrame) -> DataFrame:
    """Rows of the table for sections; keywords(section_id, keywords)."""
    return sections.join(keywords, "section_id", "left").select(
        F.lit(workspace_id).alias("workspace_id"), F.lit(workspace_name).alias("workspace_name"), "section_id", "title", T.preview("content").alias("content_preview"),
        F.coalesce("file_path", F.lit("unknown")).alias("file_path"), F.lit("document").alias("section_type"), F.coalesce("keywords", T.strings([])).alias("keywords"),
    )


def symbol_preview() -> Column:
    doc = F.when(F.coalesce(F.length("docstring"), F.lit(0)) > 0, F.concat(F.lit(" - "), F.substring("docstring", 1, 100))).otherwise("")
    return F.concat(F.concat_ws("", "type", F.lit(" "), "name", F.lit("("), "signature", F.lit(")")), doc)


def symbol_text() -> Column:
    scope = F.when(F.col("scope") != "global", F.concat(F.lit("Scope: "), F.col("scope")))
    full = lambda c: F.when(F.length(c) > 0, F.col(c))
    return F.concat_ws("\n", F.concat_ws(" ", "type", "name"), full("signature"), full("docstring"), F.concat(F.lit("File: "), F.col("file_path")), scope)


def symbol_facts(symbols: DataFrame, workspace_id: str, workspace_name: str, keywords: DataFrame) -> DataFrame:
    """Rows of the table for symbols; keywords(section_id, keywords) of their docstrings, section_id being path:line."""
    rows = symbols.withColumn("section_id", F.concat_ws(":", "file_path", "line_number"))
    return rows.join(keywords, "section_id", "left").select(
        F.lit(workspace_id).alias("workspace_id"), F.lit(workspace_name).alias("workspace_name"), "section_id", F.col("name").alias("title"), symbol_preview().alias("content_preview"),
        "file_path", F.lit("code").alias("section_type"), F.concat(F.array("name", "type", "scope"), F.coalesce("keywords", T.strings([]))).alias("keywords"),
    )


def suggestions(query: str) -> list[str]:
    """Advice for a search without results."""
    low = query.lower()
    hints = [K.KEYWORD_HINTS.get(w, w) for w in low.split() if w in K.KEYWORD_HINTS or len(w) > 3][:3]
    kind = next((k for k, marks in K.TYPE_HINTS.items() if any(m in low for m in marks)), "all")
    return [f"Search by keywords: {' '.join(hints) if hints else K.DEFAULT_HINT}", f"Choose the search type: {kind}", "Prefer two to four specific terms"]


def is_meaningful(context: str) -> bool:
    """Whether a fallback context says enough to be a result."""
    return len(re.sub(r"^\s+|\s+$", "", context)) > 50
