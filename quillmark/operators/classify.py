"""Classification of files and projects by path: expressions over built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions import constants as K
from quillmark.functions import text as T


def matches(path: Column, patterns: list[str]) -> Column:
    """*x: the path ends with x; d/: a part of the path is d; else the path holds the text. One test for each of the three kinds, however many patterns there are."""
    ends, folders = [p[1:] for p in patterns if p.startswith("*")], [p[:-1] for p in patterns if p.endswith("/") and not p.startswith("*")]
    texts = [p for p in patterns if not p.startswith("*") and not p.endswith("/")]
    any_of = lambda xs: "|".join(f"\\Q{x}\\E" for x in xs)
    out = F.lit(False)
    if ends:
        out = out | path.rlike(f"(?:{any_of(ends)})\\z")
    if folders:
        out = out | F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, folders)))
    return out | path.rlike(any_of(texts)) if texts else out


def ignored(path: Column | str, size: Column | str, patterns: list[str] | None = None, most_bytes: int = K.MAX_FILE_BYTES) -> Column:
    """Whether indexing passes a file over; a null path or size counts as ignored."""
    p, name, end = T._col(path), T.basename(path), T.suffix(path)
    hidden = name.startswith(".") & ~name.isin(K.HIDDEN_KEPT) & ~end.isin(K.HIDDEN_KEPT_SUFFIXES)
    out = (T._col(size) > most_bytes) | hidden | matches(p, K.IGNORE_PATTERNS if patterns is None else patterns)
    return F.coalesce(out, F.lit(True))


def _by_suffix(end: Column, types: dict[str, list[str]]) -> Column:
    out = F.lit("unknown")
    for kind, suffixes in reversed(types.items()):
        out = F.when(end.isin([s for s in suffixes if s.startswith(".")]), kind).otherwise(out)
    return out


def file_type(path: Column | str) -> Column:
    return _by_suffix(T.suffix(path), K.FILE_TYPES)


def tool_file_type(end: Column | str) -> Column:
    return _by_suffix(T._col(end), K.TOOL_SUFFIXES)


def project_types(files: DataFrame) -> DataFrame:
    """root and project_type of files(root, path): the first type with a marker at the root (or of a *.ext marker anywhere, d/ a folder), else mixed."""
    path = F.col("path")

    def marked(marker: str) -> Column:
        if marker.startswith("*"):
            return path.endswith(marker[1:])
        return path.startswith(marker) if marker.endswith("/") else path == marker

    kinds = list(K.PROJECT_MARKERS)
    rank = F.lit(len(kinds))
    for i in reversed(range(len(kinds))):
        rank = F.when(T._any(marked(m) for m in K.PROJECT_MARKERS[kinds[i]]), i).otherwise(rank)
    names = F.array(*map(F.lit, [*kinds, "mixed"]))
    return files.groupBy("root").agg(F.min(rank).alias("_rank")).select("root", names[F.col("_rank")].alias("project_type"))


def tags(project_type: Column, paths: Column) -> Column:
    """The type, and what the root's folders say. paths: an array of relative paths."""
    has = lambda *folders: F.exists(paths, lambda p: T._any(p.startswith(f"{d}/") for d in folders))
    return F.array_compact(F.array(project_type, F.when(has("docs"), "documentation"), F.when(has("test", "tests"), "testing"), F.when(has("api"), "api")))


def language_settings(project_type: str) -> dict:
    return K.LANGUAGE_SETTINGS.get(project_type, {})
