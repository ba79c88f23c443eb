import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
from pathlib import Path

import pytest

from quillmark.llm import near_dedup, suffix_dedup
from quillmark.llm.components import components


def brute_suffix(rows, length=400):
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    count = Counter(t[p : p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for key, t in texts:
        gone, end = bytearray(len(t)), 0
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                gone[max(p, end) : p + length] = b"\1" * (p + length - max(p, end))
                end = p + length
        spans = sum(1 for i in range(len(t)) if gone[i] and not (i and gone[i - 1]))
        out.append((key, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("split", [suffix_dedup.SPLIT, 1000, 10])
def test_suffix_dedup_equals_brute_force(spark, docs, awkward, monkeypatch, split):
    short = [r for r in awkward if len(r[1] or "") < 10_000]
    monkeypatch.setattr(suffix_dedup, "SPLIT", split)
    rows = suffix_dedup.repeats(spark.createDataFrame(short, docs.schema).repartition(3), ["doc_id"]).collect()
    assert sorted(repr((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in rows) == brute_suffix(short)


def test_suffix_dedup_of_long_texts_in_chunks(spark, awkward, monkeypatch, no_docs):
    long = [r for r in awkward if len(r[1] or "") > 10_000]
    df = spark.createDataFrame([(r[0], r[1][50_000:80_000]) for r in long], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in suffix_dedup.repeats(df, ["doc_id"]).collect()}
    assert all(r.n_removed == r.n_bytes for r in rows.values())
    assert suffix_dedup.repeats(no_docs, ["doc_id"]).count() == 0


def test_chunks_of_one_text_make_the_same_windows(monkeypatch):
    import pyarrow as pa

    rnd = random.Random(5)
    text = "".join(rnd.choice("abcdé ") for _ in range(20_000))
    batch = pa.RecordBatch.from_arrays([pa.array([b"k"]), pa.array([text])], ["key", "text"])
    windows = lambda: sorted((v, lo + d) for b in suffix_dedup._segments(iter([batch])) for v, lo, n in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()) for d in range(n - 399))
    whole = windows()
    monkeypatch.setattr(suffix_dedup, "CHUNK", 3000)
    assert windows() == whole and len(whole) == len(text.encode()) - 399


@pytest.mark.parametrize(("at_once", "step"), [(suffix_dedup.AT_ONCE, suffix_dedup.STEP), (3, 2)])
def test_suffix_order_and_common_prefixes(monkeypatch, at_once, step):
    monkeypatch.setattr(suffix_dedup, "AT_ONCE", at_once)
    monkeypatch.setattr(suffix_dedup, "STEP", step)
    rnd = random.Random(3)
    for _ in range(200):
        strings = [bytes(rnd.choice(b"ab\x00\xff c") for _ in range(rnd.randint(1, 60))) for _ in range(rnd.randint(1, 6))]
        data, ends = b"".join(strings), np.cumsum([len(s) for s in strings])
        order = suffix_dedup.suffix_order(data, ends, 10)
        suffix = lambda i: data[i : ends[np.searchsorted(ends, i, "right")]]  # noqa: B023, E731
        assert sorted(order.tolist()) == list(range(len(data)))
        assert [suffix(i)[:10] for i in order] == sorted(suffix(i)[:10] for i in order)
        whole = order[[len(suffix(i)) >= 10 for i in order]]
        some = suffix_dedup.suffix_order(data, ends, 10, True)
        same = some[[len(suffix(i)) >= 10 for i in some]]
        assert sorted(same.tolist()) == sorted(whole.tolist()) and [suffix(i)[:10] for i in same] == [suffix(i)[:10] for i in whole]
        shared = suffix_dedup.common_prefixes(data, whole, 10)
        assert all(shared[k] == len(os.path.commonprefix([suffix(whole[k])[:10], suffix(whole[k - 1])[:10]])) for k in range(1, len(whole)))


def weighted_sets(texts, idf):
    data = [t.encode() for t in texts]
    offs = np.cumsum([0, *map(len, data)])
    sets = [{} for _ in texts]
    for row, h, w in zip(*(x.tolist() for x in near_dedup.weighted_shingles(np.frombuffer(b"".join(data), np.uint8), offs, idf)), strict=True):
        sets[row][h] = w
    return sets


def similarity(a, b):
    shared = sum(min(w, b[k]) for k, w in a.items() if k in b)
    total = sum(a.values()) + sum(b.values()) - shared
    return shared / total if total else 0.0


def brute_classes(rows, idf):
    """Rows' class ids, and every similarity of different texts."""
    texts = sorted({r[1] or "" for r in rows})
    sets, parent, found = weighted_sets(texts, idf), list(range(len(texts))), []
    for i in range(len(texts)):
        for j in range(i):
            found.append(s := similarity(sets[i], sets[j]))
            if s >= 0.8:
                parent[near_dedup._find(parent, i)] = near_dedup._find(parent, j)
    least, size = {}, Counter()
    for r in rows:
        c = near_dedup._find(parent, texts.index(r[1] or ""))
        size[c] += 1
        least[c] = min((x for x in (least.get(c), r[0]) if x is not None), default=None)
    classes = [near_dedup._find(parent, texts.index(r[1] or "")) for r in rows]
    return [(r[0], least[c], size[c]) for r, c in zip(rows, classes)], found


def family(rnd, n):
    """Texts at many distances from one, and from each other."""
    base = [f"w{rnd.randrange(4000)}" for _ in range(300)]
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randint(0, 14)):
            w[rnd.randrange(len(w))] = f"v{rnd.randrange(10**6)}"
        yield " ".join(w)


@pytest.mark.parametrize(("group", "bucket"), [(near_dedup.GROUP, near_dedup.BUCKET), (7, 5)])
def test_near_duplicates_equal_brute_force(spark, docs, awkward, monkeypatch, group, bucket):
    monkeypatch.setattr(near_dedup, "GROUP", group)
    monkeypatch.setattr(near_dedup, "BUCKET", bucket)
    rows = [r[:2] for r in awkward if len(r[1] or "") < 10_000] + [(1000 + i, t) for i, t in enumerate(family(random.Random(9), 60))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    idf = near_dedup.inverse_frequencies(near_dedup.document_frequencies(df))
    want, found = brute_classes(rows, idf)
    assert sum(0.75 < s < 0.85 for s in found) > 20  # many pairs on either side of the limit
    got = near_dedup.near_duplicates(df).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_document_frequencies_count_rows(docs, awkward):
    total = near_dedup.document_frequencies(docs.select("text"))
    assert total[near_dedup.WORDS] == len(awkward)
    from quillmark.llm import _blocks as B

    word = B.slice_hashes(np.frombuffer(b"orbit", np.uint8), np.array([0]), np.array([5]))
    texts = [(r[1] or "").lower() for r in awkward]
    assert total[near_dedup._word_ids(word)[0]] >= sum("orbit" in t for t in texts) > 10


def test_samples_collide_as_often_as_weights_overlap():
    rnd = random.Random(2)
    idf = np.ones(near_dedup.WORDS, np.float32)
    for text, other in list(zip(family(rnd, 40), family(rnd, 40)))[:40]:
        data = [text.encode(), other.encode()]
        offs = np.cumsum([0, *map(len, data)])
        _, samples = near_dedup.signatures(np.frombuffer(b"".join(data), np.uint8), offs, idf)
        true = similarity(*weighted_sets([text, other], idf))
        assert abs((samples[0] == samples[1]).mean() - true) < 0.25


def test_one_of_each_class_stays(docs, awkward, no_docs):
    one, all_rows = near_dedup.one_of_each(docs), near_dedup.near_duplicates(docs).collect()
    assert one.columns == docs.columns
    classes = defaultdict(int)
    for r in all_rows:
        classes[r.class_id, r.class_size] += 1
    assert one.count() == sum(n // size for (_, size), n in classes.items())
    assert near_dedup.one_of_each(no_docs).count() == 0 and near_dedup.near_duplicates(no_docs).count() == 0


def test_components_of_paths_stars_and_loops(spark):
    rnd, n = random.Random(4), 300
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 202), (202, 200), (250, 250)]
    rnd.shuffle(edges)
    parent = list(range(n))
    for a, b in edges:
        x, y = near_dedup._find(parent, a), near_dedup._find(parent, b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: c for i in range(n) if (c := near_dedup._find(parent, i)) != i}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("few", [-1, 40, 1 << 17])
def test_few_links_are_joined_without_rounds(spark, monkeypatch, few):
    import quillmark.llm.components as module

    made = []
    monkeypatch.setattr(module, "FEW", few)
    monkeypatch.setattr(module, "written", lambda df, name, write=module.written: made.append(name) or write(df, name))
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 20)] + [(rnd.randint(200, 260), rnd.randint(200, 260)) for _ in range(40)] + [(None, 1), (7, 7), (3, 2)]
    least = {n: n for e in edges for n in e}
    for _ in edges:
        for a, b in edges:
            if a is not None:
                least[a] = least[b] = min(least[a], least[b])
    key = lambda n: None if n is None else hashlib.md5(b"%d" % n).digest()
    groups = {}
    for n in least:
        groups.setdefault(least[n], []).append(key(n))
    groups.pop(None)
    want = {k: min(g) for g in groups.values() for k in g if k != min(g)}
    rows = components(spark.createDataFrame([(key(a), key(b)) for a, b in edges], "a binary, b binary").repartition(5)).collect()
    assert {bytes(r.node): bytes(r.component) for r in rows} == want and len(rows) == len(want)
    assert len(made) == 2 if few > len(edges) else len(made) > 4


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="the driver's tables are not here")
def test_classes_of_the_tables_equal_all_pairs(spark):
    """Recall on data: the classes of all pairs of different texts, compared exactly."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {}
    for r in docs.select("doc_id", "text").collect():
        texts.setdefault(r.text or "", []).append(r.doc_id)
    data, ids = [t.encode() for t in texts], list(texts.values())
    idf = near_dedup.inverse_frequencies(near_dedup.document_frequencies(docs.select("text")))
    parent = list(range(len(data)))
    for i, j in near_dedup.similar_links(data, idf):
        parent[near_dedup._find(parent, i)] = near_dedup._find(parent, j)
    groups = {}
    for k, own in enumerate(ids):
        groups.setdefault(near_dedup._find(parent, k), []).extend(own)
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()} == {x: min(g) for g in groups.values() for x in g}
