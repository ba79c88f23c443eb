"""Quality rules by repetition coverage (operator 7).

One Arrow pass over whole texts, without a shuffle. Words are runs of bytes other than white space; all words of a
block are hashed at once, windows of 5 to 10 words get rolling hashes, and a sort of (text, window) hashes finds the
windows that a text holds more than once. A longer window can only repeat where a window of 5 words does, so lengths
above 5 are looked at there alone. Coverage is the share of the words' characters inside windows that have occurred
before in the text, and inside lines that have.

Defined cases: a null or empty text has no words and fails; a text of white space alone likewise; rows are judged one
by one, so repeated rows, null ids and further columns do not matter; texts of any length are measured whole, a long one as a block of its own; of equal lines or windows the first
is no repeat, and a measure that equals its limit passes; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import _blocks as B
from quillmark.llm._tables import add_struct, documents, unused

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
KIND = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
    "kept boolean, n_lines bigint, dup_line_chars bigint, dup_gram_chars array<bigint>"
)


@dataclass(frozen=True)
class QualityRules:
    """Limits above which a text is rejected; shares of the words' characters unless they say otherwise."""

    least_words: int = 10
    most_repeat_words: float = 0.20
    #: By n-gram length in words.
    gram_chars: dict[int, float] = field(default_factory=lambda: {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10})
    #: Share of the lines.
    dup_lines: float = 0.30
    dup_line_chars: float = 0.20
    #: Symbols for each word.
    symbols: float = 0.10


def _lines(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every newline-split line."""
    n, breaks = len(offs) - 1, np.flatnonzero(buf == 10)
    starts, ends = np.concatenate([offs[:-1], breaks + 1]), np.concatenate([breaks, offs[1:]])
    rows = np.concatenate([np.arange(n), np.searchsorted(offs, breaks, "right") - 1])
    by_start = np.lexsort((starts, rows))
    end_rows = np.concatenate([np.searchsorted(offs, breaks, "right") - 1, np.arange(n)])
    return starts[by_start], ends[np.lexsort((ends, end_rows))], rows[by_start]


def measure_block(buf: np.ndarray, offs: np.ndarray, rules: QualityRules) -> list:
    import pyarrow as pa

    n = len(offs) - 1
    mask = B.SPACED[buf]
    starts, ends, rows = B.spans(mask, offs)
    chars = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(mask & ((buf & 0xC0) != 0x80), out=chars[1:])
    size = chars[ends] - chars[starts]
    n_words, word_chars = B.per_row(rows, n), B.per_row(rows, n, size)
    symbol = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(SYMBOLS[buf], out=symbol[1:])
    n_symbols = symbol[offs[1:]] - symbol[offs[:-1]]

    line_from, line_to, line_row = _lines(buf, offs)
    full = chars[line_to] > chars[line_from]
    line_from, line_to, line_row = line_from[full], line_to[full], line_row[full]
    salt = B.mix(np.arange(1, n + 1, dtype=np.uint64))
    again = B.later(B.slice_hashes(buf, line_from, line_to) ^ salt[line_row]) if len(line_from) else np.zeros(0, bool)
    n_lines, n_dup_lines = B.per_row(line_row, n), B.per_row(line_row[again], n)
    dup_line_chars = B.per_row(line_row[again], n, (chars[line_to] - chars[line_from])[again])

    words, repeat_words, grams, at = B.slice_hashes(buf, starts, ends) if len(starts) else np.zeros(0, np.uint64), np.zeros(n, np.int64), [], None
    for length in sorted({5, *rules.gram_chars}):
        whole = B.whole_windows(rows, length)
        hashes = B.window_hashes(words, length)
        if at is None:
            at = np.flatnonzero(whole)
        else:
            at = at[at < len(whole)]
            at = at[whole[at]]
        keys = hashes[at] ^ salt[rows[at]]
        twice = B.repeated(keys)
        at, keys = at[twice], keys[twice]
        if length == 5:
            repeat_words = B.per_row(rows[B.covered(at, at + 5, len(rows))], n)
        late = at[B.later(keys)]
        inside = B.covered(late, late + length, len(rows))
        grams.append(B.per_row(rows[inside], n, size[inside]))
    base_failed = (n_words < rules.least_words) | (repeat_words > rules.most_repeat_words * n_words)
    ok = ~base_failed & (n_dup_lines <= rules.dup_lines * n_lines) & (dup_line_chars <= rules.dup_line_chars * word_chars) & (n_symbols <= rules.symbols * n_words)
    for length, inside in zip(sorted({5, *rules.gram_chars}), grams, strict=True):
        ok &= inside <= rules.gram_chars.get(length, 1.0) * word_chars
    by_row = np.stack(grams, 1).ravel() if n else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(grams)), pa.array(by_row))
    return [n_words, word_chars, n_symbols, n_dup_lines, repeat_words, base_failed, ok, n_lines, dup_line_chars, lists]


def measure(docs: DataFrame, keep: list[str], text: str = "text", rules: QualityRules = QualityRules(), into: str = "quality") -> DataFrame:
    """Columns `keep` of every row and a struct `into` of its measures and verdict."""
    return add_struct(docs, keep, into, KIND, lambda rows, buf, offs: measure_block(buf, offs, rules), text)


def filtered(docs: DataFrame, text: str = "text", rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows that the rules keep, with their columns."""
    into = unused(docs, "_quality")
    return measure(docs, docs.columns, text, rules, into).filter(F.col(f"{into}.kept")).drop(into)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measure(documents(spark, sf_dir), ["doc_id"]).select("doc_id", "quality.*")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, regexp_extract_all(t, '[^ \t-\r]+') AS ws FROM d),
x AS (SELECT k, i, ws[i] AS word FROM (SELECT k, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
g AS (SELECT k, i, unnest([5, 6, 7, 8, 9, 10]) AS n, ws, len(ws) AS m FROM (SELECT k, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
gr AS (SELECT k, i, n, ws[i:i + n - 1] AS g FROM g WHERE i + n - 1 <= m),
r AS (SELECT k, i, n, count(*) OVER (PARTITION BY k, n, g) AS c, row_number() OVER (PARTITION BY k, n, g ORDER BY i) AS nth FROM gr),
five AS (SELECT k, count(*) AS n_repeat_words FROM (SELECT DISTINCT k, i + unnest(range(5)) AS i FROM r WHERE n = 5 AND c > 1) GROUP BY k),
cov AS (SELECT k, n, sum(length(word)) AS c FROM (SELECT DISTINCT k, n, i + unnest(range(n)) AS i FROM r WHERE nth > 1) JOIN x USING (k, i) GROUP BY k, n),
covs AS (SELECT k, list(struct_pack(n := n, c := c)) AS cs FROM cov GROUP BY k),
l AS (SELECT k, p, line, row_number() OVER (PARTITION BY k, line ORDER BY p) AS nth,
             length(array_to_string(regexp_extract_all(line, '[^ \t-\r]+'), '')) AS c
      FROM (SELECT k, ls[p] AS line, p FROM (SELECT k, ls, unnest(range(1, len(ls) + 1)) AS p FROM (SELECT k, string_split(t, chr(10)) AS ls FROM d)))
      WHERE regexp_matches(line, '[^ \t-\r]')),
ls AS (SELECT k, count(*) AS n_lines, count(*) FILTER (nth > 1) AS n_dup_lines, coalesce(sum(c) FILTER (nth > 1), 0) AS dup_line_chars FROM l GROUP BY k),
b AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(dup_line_chars, 0)::BIGINT AS dup_line_chars,
             [coalesce(list_sum([s.c FOR s IN cs IF s.n = m]), 0)::BIGINT FOR m IN [5, 6, 7, 8, 9, 10]] AS dup_gram_chars
      FROM w LEFT JOIN ls USING (k) LEFT JOIN five USING (k) LEFT JOIN covs USING (k)),
v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND n_dup_lines <= 0.30 * n_lines AND dup_line_chars <= 0.20 * word_chars AND n_symbols <= 0.10 * n_words
    AND dup_gram_chars[1] <= 0.15 * word_chars AND dup_gram_chars[2] <= 0.14 * word_chars AND dup_gram_chars[3] <= 0.13 * word_chars
    AND dup_gram_chars[4] <= 0.12 * word_chars AND dup_gram_chars[5] <= 0.11 * word_chars AND dup_gram_chars[6] <= 0.10 * word_chars AS kept
FROM v
"""
