"""Personal data by bootstrapped contextual extraction (operator 9).

One Arrow pass finds the base entities (e-mail, IP, card, phone, and long hexadecimal secrets) of each whole text and the candidates: number-like,
address-like, colon-separated and assigned strings that no base rule takes. Base entities are the seeds. The lexical patterns of an occurrence are the two words
before, the word before with the word after, the two words after, and the word before with the punctuation that follows it. Values and patterns are a bipartite
graph, which Spark scores in rounds: a pattern's confidence for a kind is the share of its distinct values that bear the kind, it counts from LEAST_SEEDS
distinct values on, and a value's confidence joins its confident patterns, from all documents, as independent evidence. Values of a fitting shape at PROMOTE or
more take the kind and are seeds of the next round. Rounds end when none is promoted. Every candidate that has a promoted value is a span, in whatever context.

The base pass is written once with row numbers, so that texts are read once and only entities and patterns are shuffled, with partial aggregation; a pair of value
and pattern is one row of the graph, however often it occurs.

Defined cases: a null text is empty and has no spans; rows are kept one by one, so repeated rows and null ids do not matter (a value that repeats counts once for a pattern);
spans of different kinds may overlap and all stay; of two kinds with equal confidence the later in the alphabet is taken; further columns do not matter; an empty table gives an
empty result; texts of any length are searched whole, in time linear in the text: rules that look back over long runs are anchored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm._tables import add_struct, boxed, documents, opened, removed, unused, written

KINDS = ("email", "ip", "card", "phone")
#: Found, promoted and redacted like the others, and given in columns of its own.
SECRET = "secret"
LEAST_SEEDS = 4
CONFIDENT = 0.75
PROMOTE = 0.9

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HEX = re.compile(r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]*[0-9])(?=[0-9]*[A-Fa-f])[0-9A-Fa-f]{32,}(?![0-9A-Za-z])")
NUMBER = re.compile(r"(?<![0-9A-Za-z])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}(?![0-9A-Za-z])")
ADDRESS = re.compile(r"(?<!\S)[^\s@]+@[^\s@]{2,}(?!\S)")
COLONS = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}(?![0-9A-Fa-f:])")
ASSIGNED = re.compile(r"[=:]\x20?[\"']?([^\s\"'=:<>]{6,})")
WORD = re.compile(r"\w+")

BASE = "spans array<struct<kind:string,start:int,end:int>>"
GRAPH = "cands array<struct<kind:string,start:int,end:int,value:string,fits:string,patterns:array<string>>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base entities, leftmost and without overlap for each kind, by start and kind."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            found.append(("email", start, m.end()))
            last = m.end()
        else:
            last = max(last, at)
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if 14 <= len(digits := re.sub("[^0-9]", "", m.group())) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            found.append(("phone", *m.span()))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def secret_spans(text: str) -> list[tuple[str, int, int]]:
    return [(SECRET, *m.span()) for m in HEX.finditer(text)]


def _free(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[bool]:
    """Which spans overlap none of the taken; both by start, and the spans without overlap."""
    out, i, reach = [], 0, 0
    for s, e in spans:
        while i < len(taken) and taken[i][0] < e:
            reach = max(reach, taken[i][1])
            i += 1
        out.append(reach <= s)
    return out


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Strings shaped like an identifier outside the base entities, with the kinds that they fit."""
    found, taken = [], sorted((s, e) for _, s, e in base)
    for rule in (ADDRESS, COLONS, NUMBER, ASSIGNED):
        spans = []
        for m in rule.finditer(text):
            s, e = m.span(m.re.groups)
            if rule is ADDRESS or rule is ASSIGNED:
                while e > s and text[e - 1] in ".,;:!?)>]\"'":
                    e -= 1
                while s < e and text[s] in "(<[\"'":
                    s += 1
            if s < e:
                spans.append((s, e))
        own = []
        for (s, e), free in zip(spans, _free(spans, taken), strict=True):
            digits = sum("0" <= c <= "9" for c in text[s:e]) if free else 0
            if rule is ADDRESS:
                fits = "email" if "@" in text[s:e] else ""
            elif rule is ASSIGNED:
                fits = SECRET if digits else ""
            else:
                fits = "ip" if rule is COLONS else ",".join(k for k, ok in (("card", 12 <= digits <= 19), ("phone", 7 <= digits <= 15)) if ok)
            if free and fits:
                own.append((fits, s, e))
        found += own
        taken = sorted(taken + [(s, e) for _, s, e in own])
    return found


def patterns(text: str, words: list[tuple[int, int]], start: int, end: int) -> list[str]:
    """Contexts of a span: words before and after, lower-cased, with the digits of longer words masked. words: of the text, by start."""
    word = lambda a, b: re.sub("[0-9]", "0", text[a:b].lower()) if b - a > 2 else text[a:b].lower()
    i, j = bisect_left(words, (start, 0)), bisect_left(words, (end, 0))
    if i and words[i - 1][1] > start:  # a word that the span begins inside
        i -= 1
    before, after = [word(*w) for w in words[max(0, i - 2) : i]], [word(*w) for w in words[j : j + 2]]
    out = []
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} _")
    if len(after) == 2:
        out.append(f"_ {after[0]} {after[1]}")
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    if before and (mark := text[words[i - 1][1] : start]).strip():
        out.append(f"{before[-1]}{' '.join(mark.split())}_")
    return [x if len(x) <= 200 else blake2b(x.encode()).hexdigest() for x in out]


def _found(_, buf: np.ndarray, offs: np.ndarray) -> list:
    n = len(offs) - 1
    marks = np.concatenate([[0], np.cumsum(((buf >= 48) & (buf <= 58)) | (buf == 64))])
    spans, cands, raw = [[] for _ in range(n)], [[] for _ in range(n)], buf.tobytes()
    for i in np.flatnonzero(marks[offs[1:]] > marks[offs[:-1]]).tolist():
        text = raw[offs[i] : offs[i + 1]].decode()
        base = base_spans(text) + secret_spans(text)
        both = [(k, k, s, e) for k, s, e in base] + [(None, fits, s, e) for fits, s, e in candidates(text, base)]
        spans[i] = [{"kind": k, "start": s, "end": e} for k, s, e in base]
        words = [m.span() for m in WORD.finditer(text)] if both else []
        cands[i] = [{"kind": k, "start": s, "end": e, "value": text[s:e] if e - s <= 64 else blake2b(text[s:e].encode()).hexdigest(), "fits": fits, "patterns": patterns(text, words, s, e)} for k, fits, s, e in both]
    place = [pa.field("kind", pa.string()), pa.field("start", pa.int32()), pa.field("end", pa.int32())]
    more = [pa.field("value", pa.string()), pa.field("fits", pa.string()), pa.field("patterns", pa.list_(pa.string()))]
    return [pa.array(spans, pa.list_(pa.struct(place))), pa.array(cands, pa.list_(pa.struct(place + more)))]


def _promoted(edges: DataFrame) -> DataFrame | None:
    """value and kind of what the rounds promote. edges: pattern, value, kind, fits; one row for each pattern and value."""
    all_promoted, kinds = None, (*KINDS, SECRET)
    while True:  # each round takes one value at least out of those without a kind
        counts = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in kinds))
        by_kind = F.explode(F.array(*(F.struct(F.lit(k).alias("as"), F.col(k).alias("seeds")) for k in kinds)))
        good = counts.select("pattern", "n", by_kind.alias("x")).select("pattern", F.col("x.as").alias("as"), F.col("x.seeds").alias("seeds"), (F.col("x.seeds") / F.col("n")).alias("sure"))
        good = written(good.filter((F.col("seeds") >= LEAST_SEEDS) & (F.col("sure") >= CONFIDENT)), "pii-patterns")  # both sides of the join are plain shuffles, which adaptive execution can split
        matched = edges.filter("kind IS NULL").join(good, "pattern").filter(F.array_contains(F.split("fits", ","), F.col("as")))
        scored = matched.groupBy("value", "as").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("sure"), F.lit(0.01)))))).alias("sure"))
        best = scored.filter(F.col("sure") >= PROMOTE).groupBy("value").agg(F.max_by("as", F.struct("sure", "as")).alias("as"))
        best = written(best, "pii-promoted")
        removed(good)
        if best.isEmpty():
            return all_promoted
        all_promoted = best if all_promoted is None else all_promoted.unionByName(best)
        before, edges = edges, written(edges.join(best, "value", "left").withColumn("kind", F.coalesce("kind", "as")).drop("as"), "pii-edges")
        removed(before)


def find(docs: DataFrame, keep: list[str], text: str = "text", into: str = "pii") -> DataFrame:
    """Columns `keep` and a struct `into` of every row: `spans` by the base rules and `added` by context, in code points."""
    base = written(add_struct(boxed(docs, keep, text=text), ["_box"], "_pii", f"{BASE}, {GRAPH}", _found).withColumn("_row", F.monotonically_increasing_id()), "pii-base")
    each = base.filter(F.size("_pii.cands") > 0).select("_row", F.explode("_pii.cands").alias("c"))
    pairs = each.select("c.value", "c.kind", "c.fits", F.explode("c.patterns").alias("pattern"))
    edges = pairs.groupBy("pattern", "value").agg(F.max("kind").alias("kind"), F.max("fits").alias("fits"))
    promoted = _promoted(written(edges, "pii-edges"))
    none, spans = F.array().cast("array<struct<kind:string,start:int,end:int>>"), F.col("_pii.spans").alias("spans")
    if promoted is None:
        return opened(base, keep, F.struct(spans, none.alias("added")).alias(into))
    unseen = each.filter("c.kind IS NULL").select("_row", "c.start", "c.end", "c.fits", F.col("c.value").alias("_v"))
    hits = unseen.join(promoted, F.col("_v") == F.col("value")).filter(F.array_contains(F.split("fits", ","), F.col("as")))
    lists = hits.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", F.col("as").alias("kind"), "end"))).alias("_added"))
    added = F.coalesce(F.transform("_added", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))), none)
    return opened(base.join(lists, "_row", "left"), keep, F.struct(spans, added.alias("added")).alias(into))


def _rank(kind):
    return F.array_position(F.array(*map(F.lit, (*KINDS, SECRET))), kind)


def joined(spans):
    """kind:start:end of an array of spans by start, then kind as listed, comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("s"), _rank(x["kind"]).alias("r"), x["end"].alias("e"), x["kind"].alias("k"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["k"], x["s"], x["e"])), ",")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows, every span of the text replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    into, names, own = unused(docs, "_pii"), docs.columns, unused(docs, "_cuts")
    found = find(docs, names, text, into)
    ordered = F.array_sort(F.transform(F.concat(f"{into}.spans", f"{into}.added"), lambda x: F.struct(x["start"].alias("s"), _rank(x["kind"]).alias("r"), x["end"].alias("e"), x["kind"].alias("k"))))
    place = "struct<s:int,e:int,k:string>"
    empty = F.array().cast(f"array<{place}>")
    merged = F.aggregate(
        ordered,
        empty,
        lambda got, x: F.when(
            (F.size(got) > 0) & (F.try_element_at(got, F.lit(-1))["e"] > x["s"]),
            F.concat(
                F.slice(got, 1, F.size(got) - 1),
                F.array(F.struct(F.try_element_at(got, F.lit(-1))["s"].alias("s"), F.greatest(F.try_element_at(got, F.lit(-1))["e"], x["e"]).alias("e"), F.try_element_at(got, F.lit(-1))["k"].alias("k")).cast(place)),
            ),
        ).otherwise(F.concat(got, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")).cast(place)))),
    )
    cuts, body = F.col(own), F.col(f"`{text}`")
    pieces = F.transform(
        F.sequence(F.lit(0), F.size(cuts)),
        lambda i: F.concat(
            F.when(i == 0, "").otherwise(F.concat(F.lit("<"), F.upper(F.try_element_at(cuts, i)["k"]), F.lit(">"))),
            F.substring(
                body,
                F.when(i == 0, 0).otherwise(F.try_element_at(cuts, i)["e"]) + 1,
                F.coalesce(F.try_element_at(cuts, i + 1)["s"], F.length(body)) - F.when(i == 0, 0).otherwise(F.try_element_at(cuts, i)["e"]),
            ),
        ),
    )
    clean = F.when(F.size(cuts) > 0, F.array_join(pieces, "")).otherwise(body)
    return found.withColumn(own, merged).withColumn(text, clean).select(*(F.col(f"`{c}`") for c in names))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir), ["doc_id"])
    listed = lambda spans: F.filter(spans, lambda x: x["kind"] != SECRET)
    n = lambda k: F.size(F.filter("pii.spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    both = F.concat("pii.spans", "pii.added")
    secrets = F.filter(both, lambda x: x["kind"] == SECRET)
    return found.select(
        "doc_id",
        *map(n, KINDS),
        F.sha2(joined(listed(F.col("pii.spans"))), 256).alias("base_sha256"),
        joined(listed(both)).alias("spans"),
        F.size("pii.added").cast("long").alias("n_added"),
        F.size(secrets).cast("long").alias("n_secret"),
        joined(secrets).alias("secret_spans"),
        F.size(both).cast("long").alias("n_spans"),
    )
