"""Substring dedup by hashed units of text (operator 2).

Units are whole lines of any length and, inside the lines that stay, sentences of `least_words` words or more (`line_repeats`, the query's form); or any pieces that
a separator cuts, lines, paragraphs or lines cut at sentence ends (`repeats`). A unit is normalised (lower case, white-space runs as one space, ends
trimmed) and digested. Digests are grouped over all documents: the occurrence with the least rank (doc_id, nulls last, then row, then place) stays, the
others go, with their offsets in code points of the original text.

Whole lines alone would miss a passage put into the middle of a line, which these data hold: its whole sentences are units too. Shorter sentences inside a line that is
itself unique repeat by chance and stay. Two letters of a script without spaces count as a word. A line's first occurrence holds the first of its sentences too, so one
grouping serves both.

Texts are split in one Arrow pass, which is written with row numbers; units carry digests and places, not text. Digests that occur once drop out before
the join that marks removals; grouping combines map-side, so a line that a third of all rows share leaves one row in each task, and the join back is split where skewed.

Defined cases: null and empty texts have no units and are returned as they are; texts of any length are split whole; of repeated rows (equal id and text) one keeps its units and
the others lose them, in no stated order; an empty table gives an empty result; further columns do not matter.
"""

from __future__ import annotations

import re
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm._tables import add_struct, boxed, documents, written

#: Words of a sentence inside a line that stays; lines have no least length.
LEAST_WORDS = 10
#: What ends a unit; it stays with the unit, so that places add up and cuts leave no blank line behind.
LINE, PARAGRAPH, SENTENCE = r"\n", r"\n\n+", r"\n|[.!?]\x20"
SPACES = re.compile(r"[\x20\x09-\x0D]+")
KIND = "units array<struct<start:int,end:int,digest:binary>>"
#: `line` is null for a whole line and else the start of the line that a sentence is in.
NESTED = "units array<struct<start:int,end:int,digest:binary,line:int>>"
#: Sentence ends inside a line, and letters of scripts that put no spaces between words (Thai to Myanmar, Khmer, kana, Han).
INNER = re.compile(r"[.!?]\x20|[\u3002\uFF01\uFF1F]")
SPACELESS = re.compile("[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\U00020000-\U0003FFFF]")


def units_of(text: str, ends: re.Pattern, least_words: int) -> list[tuple[int, int, bytes]]:
    """(start, end, digest) of the units that have words enough."""
    out, at = [], 0
    for end in (*(m.end() for m in ends.finditer(text)), len(text)):
        if at < end:
            normal = SPACES.sub(" ", text[at:end].lower()).strip(" ")
            if normal and normal.count(" ") >= least_words - 1:
                out.append((at, end, blake2b(normal.encode(), digest_size=16).digest()))
            at = end
    return out


def nested_units_of(text: str, least_words: int) -> list[tuple[int, int, bytes, int | None]]:
    """(start, end, digest, line) of all lines that are not blank and of the sentences inside them that have words enough."""
    out, at = [], 0
    for line in text.split("\n"):
        start, stop = at, min(at + len(line) + 1, len(text))
        normal = SPACES.sub(" ", line.lower()).strip(" ")
        if normal:
            out.append((start, stop, blake2b(normal.encode(), digest_size=16).digest(), None))
            for end in (*(start + m.end() for m in INNER.finditer(line)), stop):
                inner = SPACES.sub(" ", text[at:end].lower()).strip(" ")
                if inner and inner != normal and inner.count(" ") + 1 + len(SPACELESS.findall(inner)) // 2 >= least_words:
                    out.append((at, end, blake2b(inner.encode(), digest_size=16).digest(), start))
                at = end
        at = stop
    return out


def _split(units, names: tuple[str, ...]):
    """units: from a text to tuples in the order of names."""
    kinds = {"digest": pa.binary()}
    kind = pa.list_(pa.struct([pa.field(n, kinds.get(n, pa.int32())) for n in names]))

    def make(_, buf, offs) -> list:
        raw = buf.tobytes()
        return [pa.array([[dict(zip(names, u, strict=True)) for u in units(raw[a:b].decode())] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], kind)]

    return make


def repeats(docs: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text", separator: str = LINE, least_words: int = 1) -> DataFrame:
    """Columns `keep` and _removed of every row: the code-point ranges of units that occur earlier in rank, in order."""
    ends = re.compile(separator)
    return _marked(docs, keep, key, text, KIND, _split(lambda t: units_of(t, ends, least_words), ("start", "end", "digest")))


def line_repeats(docs: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """As repeats, of whole lines of any length and of the sentences inside lines that stay; a removed line is one range."""
    return _marked(docs, keep, key, text, NESTED, _split(lambda t: nested_units_of(t, least_words), ("start", "end", "digest", "line")))


def _marked(docs: DataFrame, keep: list[str], key: str, text: str, kind: str, split) -> DataFrame:
    others = [c for c in keep if c != text]
    rows = boxed(docs, others, _key=key, text=text)
    base = written(add_struct(rows, ["_box", "_key", *(["text"] if text in keep else [])], "_made", kind, split).withColumn("_row", F.monotonically_increasing_id()), "units")
    each = base.select(F.struct(F.col("_key").isNull().alias("n"), F.col("_key").alias("k"), F.col("_row").alias("r")).alias("_rank"), F.explode("_made.units").alias("u"))
    line = [F.col("u.line").alias("_line")] if kind == NESTED else []
    found = each.select("_rank", F.col("u.start").alias("_at"), F.col("u.end").alias("_end"), F.col("u.digest").alias("_digest"), *line)
    first = found.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("_rank", "_at")).alias("_first")).filter("_n > 1").select(F.col("_digest").alias("_d"), "_first")
    first = written(first, "units-first")  # a plain shuffle on both sides of the join, which adaptive execution can split
    late = found.join(first, F.col("_digest") == F.col("_d")).filter((F.col("_rank.r") != F.col("_first._rank.r")) | (F.col("_at") != F.col("_first._at")))
    late = late.withColumn("_row", F.col("_rank.r"))
    span = F.struct(F.col("_at").alias("start"), F.col("_end").alias("end"))
    if kind == NESTED:
        whole = F.max(F.when(F.col("_line").isNull(), span))
        by_line = late.groupBy("_row", F.coalesce("_line", "_at").alias("_line")).agg(whole.alias("_whole"), F.collect_list(span).alias("_inner"))
        spans = F.flatten(F.collect_list(F.when(F.col("_whole").isNotNull(), F.array("_whole")).otherwise(F.col("_inner"))))
        lists = by_line.groupBy("_row").agg(F.sort_array(spans).alias("_removed"))
    else:
        lists = late.groupBy("_row").agg(F.sort_array(F.collect_list(span)).alias("_removed"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    marked = base.join(lists, "_row", "left")
    return marked.select(*(F.col("text").alias(c) if c == text else F.col(f"_box.`{c}`").alias(c) for c in keep), F.coalesce("_removed", none).alias("_removed"))


def without(text, spans):
    """The text column without the ranges of a sorted array of spans."""
    end_before = lambda i: F.when(i == 0, 0).otherwise(F.try_element_at(spans, i)["end"])
    pieces = F.transform(F.sequence(F.lit(0), F.size(spans)), lambda i: F.substring(text, end_before(i) + 1, F.coalesce(F.try_element_at(spans, i + 1)["start"], F.length(text)) - end_before(i)))
    return F.when(F.size(spans) > 0, F.array_join(pieces, "")).otherwise(text)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_repeats(documents(spark, sf_dir), ["doc_id", "text"])
    kept = F.coalesce(without(F.col("text"), F.col("_removed")), F.lit(""))
    spans = F.array_join(F.transform("_removed", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    cut = F.aggregate("_removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", F.size("_removed").cast("long").alias("n_removed"), cut.alias("removed_chars"), spans.alias("removed_spans"), F.length(kept).cast("long").alias("kept_chars"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT k, doc_id, t, n, ls[n] AS line FROM (SELECT k, doc_id, t, ls, unnest(range(1, len(ls) + 1)) AS n FROM (SELECT *, string_split(t, chr(10)) AS ls FROM d))),
p AS (SELECT *, trim(regexp_replace(lower(line), '[ \t-\r]+', ' ', 'g')) AS norm,
             (sum(length(line) + 1) OVER (PARTITION BY k ORDER BY n) - length(line) - 1)::BIGINT AS s FROM l),
whole AS (SELECT *, least(s + length(line) + 1, length(t))::BIGINT AS e FROM p WHERE norm <> ''),
cut AS (SELECT k, doc_id, s AS line_at, e AS line_end, norm AS line_norm, i, ps[i] AS piece, len(ps) AS m
        FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM (SELECT *, string_split(regexp_replace(line, '([.!?] |[\x{3002}\x{FF01}\x{FF1F}])', '\1' || chr(1), 'g'), chr(1)) AS ps FROM whole))),
piece AS (SELECT *, trim(regexp_replace(lower(piece), '[ \t-\r]+', ' ', 'g')) AS norm, (line_at + sum(length(piece)) OVER (PARTITION BY k, line_at ORDER BY i) - length(piece))::BIGINT AS s FROM cut),
inner_units AS (SELECT k, doc_id, line_at, s, CASE WHEN i = m THEN line_end ELSE s + length(piece) END AS e, norm FROM piece
    WHERE norm <> '' AND norm <> line_norm AND len(string_split(norm, ' ')) + (length(norm) - length(regexp_replace(norm,
        '[\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]', '', 'g'))) // 2 >= 10),
u AS (SELECT k, doc_id, s AS line_at, true AS is_line, s, e, norm FROM whole UNION ALL SELECT k, doc_id, line_at, false, s, e, norm FROM inner_units),
late AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST, k, s) AS nth FROM u) WHERE nth > 1),
gone AS (SELECT k, s, e FROM (SELECT *, bool_or(is_line) OVER (PARTITION BY k, line_at) AS with_line FROM late) WHERE is_line = with_line),
around AS (SELECT k, s, e, lag(e, 1, 0) OVER (PARTITION BY k ORDER BY s) AS before FROM gone),
sums AS (SELECT k, count(*) AS n, sum(e - s) AS chars, max(e) AS last, string_agg(s || ':' || e, ',' ORDER BY s) AS spans,
                string_agg(substr(t, before + 1, s - before), '' ORDER BY s) AS pieces FROM around JOIN d USING (k) GROUP BY k)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_removed, coalesce(chars, 0)::BIGINT AS removed_chars, coalesce(spans, '') AS removed_spans,
    (length(t) - coalesce(chars, 0))::BIGINT AS kept_chars, sha256(coalesce(pieces, '') || substr(t, coalesce(last, 0) + 1)) AS kept_sha256
FROM d LEFT JOIN sums USING (k)
"""
