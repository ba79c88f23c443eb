import re

import numpy as np
import pytest

from quillmark.llm import mixing, token_counts
from quillmark.llm._tables import new_path


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_reshare_what_capped_sources_leave():
    aims = mixing.targets([100, 100, 10, 0, 790], mixing.Mix())
    assert aims[3] == 0 and aims[2] == 30 and sum(aims) == pytest.approx(1000)
    assert aims[1] == 300 and aims[0] == pytest.approx(670 / 3) and aims[4] == pytest.approx(2 * 670 / 3)
    assert mixing.targets([], mixing.Mix()) == [] and mixing.targets([0, 0], mixing.Mix()) == [0, 0]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutations_are_permutations(n):
    for key in (0, 5, 1 << 70):
        assert sorted(mixing.permuted(np.arange(n), n, key).tolist()) == list(range(n))
    if n > 60:
        assert mixing.permuted(np.arange(n), n, 1).tolist() != mixing.permuted(np.arange(n), n, 2).tolist()


def test_shards_meet_the_totals():
    mix = mixing.Mix(shard=64)
    rows = list(mixing.draw_shards(np.array([5, 0, 70, 1000]), mix))
    drawn = np.array([c for _, _, c in rows])
    assert [k for k, _, _ in rows] == list(range(17)) and drawn.sum(0).tolist() == [5, 0, 70, 1000] and (drawn.sum(1)[:-1] == 64).all()
    assert (np.array([b for _, b, _ in rows]) == np.cumsum(drawn, 0) - drawn).all() and len({tuple(c) for c in drawn.tolist()}) > 5
    some = list(mixing.draw_shards(np.array([5, 0, 70, 1000]), mix, 3, 9))
    assert repr(some) == repr(rows[3:9]) and not list(mixing.draw_shards(np.zeros(3, np.int64), mix))


def brute_mix(rows, order, mix, plan):
    """(words taken of each row, text of each (rank, block)) by prefix sums and slots in plain Python. order: of the rows in their source."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    taken, texts = [0] * len(rows), {}
    for rank, name in enumerate(names):
        stream = [(i, w) for i in order if rows[i][3] == name for w in words[i]]
        for b in range(-(-len(stream) // mix.block)):
            part = stream[b * mix.block : (b + 1) * mix.block]
            texts[rank, b] = " ".join(w for _, w in part)
            for i, _ in part:
                taken[i] += plan.get((rank, b), 0)
    return taken, texts


def test_mix_equals_brute_force(spark, no_docs):
    import random
    from collections import Counter

    rnd, mix = random.Random(4), mixing.Mix(block=7, shard=16)
    texts = [" ".join(f"w{rnd.randint(0, 99)}" for _ in range(rnd.randint(1, 40))) + rnd.choice(["", " ", "\n"]) for _ in range(40)] + [rnd.choice([None, "", " \n "]) for _ in range(60)]
    rnd.shuffle(texts)
    rows = [(i, t, "en", rnd.choice(["a", "b", "c", "c", "c", None]), 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    hashes = {r.doc_id: (r._k1, r._k2) for r in df.select("doc_id", *mixing.row_key("doc_id", "text")).collect()}
    blocks = mixing.output_blocks(df, mix).collect()
    plan = Counter((b["rank"], b.block) for b in blocks)
    assert sorted(Counter(b.shard for b in blocks).values())[1:] == [16] * (len({b.shard for b in blocks}) - 1)
    assert len({(b["rank"], b.slot) for b in blocks}) == len(blocks)  # every slot once
    for b in blocks:
        n = max(x.block for x in blocks if x["rank"] == b["rank"])
        assert plan[b["rank"], b.block] <= 3 and b["pass"] == b.slot // max(1, -(-sum(size_of(r[1]) for r in rows if r[3] == [*sorted({x[3] for x in rows if x[3]}), None][b["rank"]]) // 7)) and n >= b.block
    taken, want = brute_mix(rows, sorted(range(len(rows)), key=lambda i: hashes[i]), mix, plan)
    assert all(b.text == want[b["rank"], b.block] for b in blocks)
    assert {r.doc_id: r.taken for r in mixing.takes(df, mix).collect()} == dict(enumerate(taken))
    assert mixing.output_blocks(no_docs, mix).count() == 0


def test_mix_takes_near_target_and_agrees_with_its_blocks(docs, awkward, no_docs):
    mix = mixing.Mix(block=16, shard=128)
    rows = mixing.takes(docs, mix).collect()
    assert sorted(repr((r.doc_id, r.size)) for r in rows) == sorted(repr((r[0], size_of(r[1]))) for r in awkward)
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    by_source = {}
    for r in rows:
        t = by_source.setdefault((r.source_size, r.target), [0, 0])
        t[0] += r.taken
        t[1] += r["size"]
    for (source_size, target), (taken, size) in by_source.items():
        assert size == source_size and abs(taken - target) <= 24  # half a block of rounding, and the short last block
    assert sum(t for _, t in by_source) == pytest.approx(sum(size_of(r[1]) for r in awkward))
    again = mixing.takes(docs.repartition(2), mix).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))
    blocks = mixing.output_blocks(docs, mix).collect()
    assert sum(len(b.text.split()) for b in blocks) == sum(r.taken for r in rows)
    assert all(len(b.text.split()) <= 16 for b in blocks)
    assert mixing.takes(no_docs, mix).count() == 0


def test_token_counts_equal_the_library(spark, docs, awkward, no_docs, monkeypatch):
    path, cache = token_counts.vocabulary_path(), new_path(spark, "test-cache")
    count = lambda x: len(token_counts.counter(path).tokenizer.encode(x or "", add_special_tokens=False))
    want = sorted(repr((r[0], r[1], count(r[1]))) for r in awkward)
    got = lambda: sorted(repr((r.doc_id, r.text, r.n_tokens)) for r in token_counts.counted(docs, ["doc_id", "text"], path, cache).collect())
    assert got() == want
    stored = spark.read.parquet(cache).count()
    assert stored == len({re.sub("[ \n]+", " ", r[1] or "") for r in awkward})
    assert got() == want and spark.read.parquet(cache).count() == stored
    assert token_counts.counted(no_docs, ["doc_id"], path, cache).count() == 0
    # Some new texts beside stored ones: those alone are encoded.
    more = docs.unionByName(spark.createDataFrame([(500 + i, t, "en", "s", 1, "q", 1, "k") for i, t in enumerate(["new text one", "new text one", "new  text two"])], docs.schema))
    rows = token_counts.counted(more, ["text"], path, cache).collect()
    assert sorted((r.text or "", r.n_tokens) for r in rows) == sorted((r.text or "", count(r.text)) for r in rows) and spark.read.parquet(cache).count() == stored + 2


def test_op5_counts_from_stored_counts(spark, docs, awkward, tmp_path):
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    rows = token_counts.op5_token_counts(spark, str(tmp_path)).collect()
    library = token_counts.counter(token_counts.vocabulary_path()).tokenizer
    want = [(r[0], len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False))) for r in awkward]
    assert sorted(map(repr, ((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows))) == sorted(map(repr, ((*w, w[2] > 2048) for w in want)))


def test_token_counts_write_no_file_for_every_partition(spark, docs, awkward, tmp_path):
    docs.select("text").write.parquet(f"{tmp_path}/texts")
    docs = spark.read.parquet(f"{tmp_path}/texts")
    path, cache, confs = token_counts.vocabulary_path(), new_path(spark, "test-cache"), {"spark.sql.shuffle.partitions": "90", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        rows, most = token_counts.counted(docs, ["text"], path, cache), 3 * spark.sparkContext.defaultParallelism
        assert len(spark.read.parquet(cache).inputFiles()) <= most < 45 and rows.rdd.getNumPartitions() <= most
        assert sorted((r.text or "", r.n_tokens) for r in rows.collect()) == sorted((r[1] or "", token_counts.counter(path).whole([r[1] or ""])[0]) for r in awkward)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_token_pieces_and_special_strings():
    counter = token_counts.counter(token_counts.vocabulary_path())
    assert counter.by_piece
    texts = ["Hello  world's\n<|endoftext|> x", "<|startoftext|>a", "É é é ́a", "", " ", "a\tb c d", "x" * 5000]
    assert counter.count(texts) == counter.whole(texts)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_vocabularies(spark, docs, name):
    path = token_counts.vocabulary_path(name)
    rows = token_counts.counted(docs, ["text"], path, new_path(spark, "test-cache")).collect()
    texts = [r.text or "" for r in rows]
    assert [r.n_tokens for r in rows] == token_counts.Counter(path).whole(texts)
