"""Column functions over text. All are built-in expressions, so they stay in generated code and need no shuffle.

A word is a run of Unicode letters, numbers and underscores; white space is trimmed as Unicode white space, not spaces alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions import constants as K

NOT_WORD = r"[^\p{L}\p{N}_]+"
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(x), f"^{SPACE}+", ""), f"{SPACE}+\\z", "")


def strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def words(x: Column | str) -> Column:
    """Lower-cased words in order."""
    return F.filter(F.split(F.lower(_col(x)), NOT_WORD), lambda w: w != "")


def index_tokens(title: Column | str, content: Column | str) -> Column:
    return words(F.concat_ws(" ", _col(title), _col(content)))


def query_terms(x: Column | str) -> Column:
    """Words of three characters or more outside the stop list, duplicates kept."""
    return F.filter(words(x), lambda w: (F.length(w) > 2) & ~w.isin(K.QUERY_STOP_WORDS))


def expanded(terms: Column | str) -> Column:
    """The distinct terms and their one-hop synonyms."""
    table = F.create_map(*(x for k, v in K.SYNONYMS.items() for x in (F.lit(k), strings(v))))
    more = F.transform(_col(terms), lambda t: F.coalesce(table[t], strings([])))
    return F.array_distinct(F.concat(_col(terms), F.flatten(more)))


def basic_terms(x: Column | str) -> Column:
    return F.filter(words(x), lambda w: (F.length(w) > 2) & ~w.isin(K.BASIC_STOP_WORDS))


def spaced(x: Column | str) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(_col(x), f"{SPACE}+"), lambda w: w != "")


def global_terms(x: Column | str) -> Column:
    """White-space terms of three characters or more; punctuation and duplicates stay."""
    return F.filter(spaced(F.lower(_col(x))), lambda w: F.length(w) > 2)


def cleaned_query(x: Column | str) -> Column:
    """The query without stop phrases (cut as raw substrings, in order) and stop words; the query itself if nothing is left."""
    out = F.lower(_col(x))
    for phrase in K.CLEANER_STOP_PHRASES:
        out = F.replace(out, F.lit(phrase), F.lit(" "))
    kept = F.filter(spaced(out), lambda w: (F.length(w) > 2) & ~w.isin(K.CLEANER_STOP_WORDS))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(_col(x))


def suggested_keywords(x: Column | str) -> Column:
    table = F.create_map(*(F.lit(v) for pair in K.KEYWORD_HINTS.items() for v in pair))
    hints = F.filter(F.transform(spaced(F.lower(_col(x))), lambda w: F.coalesce(table[w], F.when(F.length(w) > 3, w))), lambda w: w.isNotNull())
    return F.when(F.size(hints) > 0, F.array_join(F.slice(hints, 1, 3), " ")).otherwise(K.DEFAULT_HINT)


def suggested_type(x: Column | str) -> Column:
    low, out = F.lower(_col(x)), F.lit("all")
    for kind, hints in reversed(K.TYPE_HINTS.items()):
        out = F.when(_any(low.contains(h) for h in hints), kind).otherwise(out)
    return out


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def occurrences(text: Column, part: Column) -> Column:
    """How often a non-empty part occurs without overlap."""
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")


def token_estimate(x: Column | str) -> Column:
    return (F.length(_col(x)) / 4).cast("bigint")


def word_count(x: Column | str) -> Column:
    return F.size(spaced(x)).cast("bigint")


def preview(x: Column | str, n: int = 200) -> Column:
    """The first n characters, with dots only if there are more."""
    return F.when(F.length(_col(x)) > n, F.concat(F.substring(_col(x), 1, n), F.lit("..."))).otherwise(_col(x))


def dotted_preview(x: Column | str, n: int = 200) -> Column:
    return F.concat(F.substring(_col(x), 1, n), F.lit("..."))


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def suffix(path: Column | str) -> Column:
    """The lower-cased last suffix with its dot; empty for none, also for a name that only starts or ends with a dot."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column | str) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def sentences(x: Column | str) -> Column:
    return F.filter(F.transform(F.split(_col(x), "[.!?]+"), strip), lambda s: s != "")


def clean_markdown(x: Column | str) -> Column:
    """Images, link targets, code, tags and surplus blank space removed."""
    out = _col(x)
    for pattern, by in (
        (r"(?d)!\[.*?\]\(.*?\)", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"```[\s\S]*?```", ""), (r"`[^`]+`", ""), (r"<[^>]+>", ""), (r"\n\s*\n", "\n\n"), (" +", " "),
    ):
        out = F.regexp_replace(out, pattern, by)
    return strip(out)


def normalized_space(x: Column | str) -> Column:
    out = _col(x)
    for pattern, by in ((" +", " "), (r"\n\s*\n\s*\n+", "\n\n"), (r" +\n", "\n")):
        out = F.regexp_replace(out, pattern, by)
    return strip(out)


def comments(content: Column | str, language: Column | str) -> Column:
    """Line comments, and for C-like languages then block comments; empty ones dropped."""
    lines = F.split(_col(content), "\n")

    def of_lines(mark: str) -> Column:
        return F.transform(lines, lambda x: strip(F.regexp_extract(x, f"(?d){mark}\\s*(.+)", 1)))

    block = F.transform(
        F.regexp_extract_all(_col(content), F.lit(r"(/\*[\s\S]*?\*/)")),
        lambda b: strip(F.regexp_replace(F.regexp_replace(b, r"/\*|\*/", ""), r"(?m)^\s*\*\s*", "")),
    )
    found = F.when(_col(language).isin("python", "shell", "ruby"), of_lines("#")).when(_col(language).isin("javascript", "typescript", "java", "c", "cpp"), F.concat(of_lines("//"), block))
    return F.filter(F.coalesce(found, strings([])), lambda c: c != "")


def health_label(mean_health: Column | str) -> Column:
    """The second limit can never be reached, as in the rule that this states."""
    h = _col(mean_health)
    return F.when(h < 0.8, "warning").when(h < 0.5, "critical").otherwise("healthy")
