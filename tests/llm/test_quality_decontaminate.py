import re
from collections import Counter

import pytest

from quillmark.llm import decontaminate, quality


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    chars = sum(map(len, words))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), []
    for x in lines:
        if x in seen:
            dup.append(x)
        seen.add(x)
    line_chars = sum(len("".join(re.findall(r"[^\x20\x09-\x0D]+", x))) for x in dup)
    covers, repeat = [], 0
    for n in range(5, 11):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        count, met, inside = Counter(grams), set(), set()
        for i, g in enumerate(grams):
            if g in met:
                inside |= set(range(i, i + n))
            met.add(g)
        covers.append(sum(len(words[i]) for i in inside))
        if n == 5:
            repeat = len({j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 5)})
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(words) < 10 or 100 * repeat > 20 * len(words)
    kept = not failed and len(dup) <= 0.3 * len(lines) and line_chars <= 0.2 * chars and symbols <= 0.1 * len(words)
    kept = kept and all(c <= limit * chars for c, limit in zip(covers, (0.15, 0.14, 0.13, 0.12, 0.11, 0.10)))
    return (len(words), chars, symbols, len(dup), repeat, failed, kept, len(lines), line_chars, covers)


def test_quality_equals_brute_force(docs, awkward):
    got = sorted((repr((r.doc_id, r.text)), tuple(r.m)) for r in quality.measure(docs, ["doc_id", "text"], into="m").collect())
    want = sorted((repr((r[0], r[1])), brute_quality(r[1])) for r in awkward)
    assert got == want


def test_quality_keeps_columns_and_empty_tables(docs, no_docs):
    kept = quality.filtered(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert quality.filtered(no_docs).count() == 0


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_scan(text, items):
    words, hit, found = words_of(text), set(), set()
    for item, body in items:
        w = words_of(body)
        n = min(len(w), 10)
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add("" if item is None else str(item))
    return len(words), sorted(hit), sorted(found)


@pytest.fixture(scope="module")
def items(awkward):
    texts = [r[1] for r in awkward]
    return [(1, " ".join(texts[3].split()[2:16])), (2, "ONE, two three FOUR"), (2, texts[6][:200]), (10, None), (11, ""), (None, " ".join(texts[9].split()[:12])), (12, "no such words at all in any text here ever"), (13, texts[46][:300])]


@pytest.mark.parametrize("max_bytes", [decontaminate.MAX_SET_BYTES, 300])
def test_decontamination_equals_brute_force(spark, docs, awkward, items, max_bytes):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.scan(docs, bench, ["doc_id", "text"], max_bytes=max_bytes).collect()
    assert decontaminate.window_sets(bench, max_bytes=300)[0] > 1
    want = sorted(repr((r[0], r[1], *brute_scan(r[1], items))) for r in awkward)
    assert sorted(repr((r.doc_id, r.text, r.found.n_words, r.found.hit_words, r.found["items"])) for r in got) == want


def test_decontamination_removes_documents_or_spans(spark, docs, awkward, items, no_docs):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    clean = decontaminate.without_documents(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == sum(not brute_scan(r[1], items)[1] for r in awkward)
    cut = decontaminate.without_spans(docs, bench)
    assert cut.count() == len(awkward)
    assert decontaminate.without_documents(cut, spark.createDataFrame(items[:1], "item_id bigint, text string")).count() == len(awkward)
    untouched = {repr(r[1]) for r in awkward if not brute_scan(r[1], items)[1]}
    assert untouched <= {repr(r.text) for r in cut.collect()}
    assert decontaminate.without_documents(no_docs, bench).count() == 0
    assert decontaminate.without_documents(docs, bench.limit(0)).count() == len(awkward)
