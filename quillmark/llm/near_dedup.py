"""MinHash near-dedup by improved consistent weighted sampling (operator 10).

A text is its shingles of five lower-cased words (a shorter text is one shingle), weighted by their count in the text times the mean inverse document
frequency of their words. Document frequencies are counted over all texts, for WORDS hashed words (a fixed size, so the table can be broadcast):
frequencies of whole shingles would need a shuffle of several times the input, and would weigh down just what copies share.

1. Equal texts are one node, the MD5 of the text. Each gets SAMPLES consistent samples; a sample is the shingle of least ln a = ln c - r (t - beta) - r
   with t = floor(ln weight / r + beta), where r, c ~ Gamma(2, 1) and beta ~ U(0, 1) come from a table that the shingle's hash indexes.
2. ROWS samples make a band. At similarity 0.8, one of BANDS bands agrees with probability 0.99997. Inside a bucket, signatures that agree in
   NEAR of the samples or more (over four standard deviations below 0.8) are joined to stars; a bucket of over BUCKET texts is one star.
   Stars' components are the groups inside which all similar pairs lie.
3. Each group's texts meet once, and its pairs' weighted Jaccard similarities are computed exactly over an inverted index of the group; pairs of 0.8 or more
   link their texts, and the links' components are the classes. A group of over GROUP texts or GROUP_BYTES is dealt out as pairs of blocks, so that no task
   holds more than two blocks and no pair is lost.

Nothing about documents comes to the driver but counts. A class of copies, however large, is one node until the end, where classes are joined to documents by
text key; adaptive execution splits the copies of a hot key.

Defined cases: a null text counts as empty; equal texts are always one class, texts without words have no other partner; texts of any length are shingled whole; repeated rows are copies; the class id
is the least doc_id of the class, null if it has none; pairs of exactly 0.8 are linked; an empty table gives an empty result; further columns do not matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import _blocks as B
from quillmark.llm._tables import documents, removed, unused, written
from quillmark.llm.components import components

SHINGLE = 5
SIMILAR = 0.8
ROWS, BANDS = 4, 20
SAMPLES = ROWS * BANDS
NEAR = 0.62
BUCKET = 2048
GROUP, GROUP_BYTES = 1024, 16 << 20
WORD_BITS = 18
WORDS = 1 << WORD_BITS
SLICES = 16
DRAWS = 1 << 16
U64 = np.uint64


def _word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, starts, ends, rows = B.plain_words(buf, offs)
    return (B.slice_hashes(low, starts, ends) if len(starts) else np.zeros(0, U64)), rows


def _word_ids(words: np.ndarray) -> np.ndarray:
    return (words >> U64(64 - WORD_BITS)).astype(np.int64)


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """Documents that hold each hashed word, over all rows of a column `text`; then the number of rows."""

    def count(batches):
        import zstandard

        total = np.zeros(WORDS + 1, np.int64)
        for rows, buf, offs in B.blocks(batches, "text"):
            words, at = _word_hashes(buf, offs)
            pairs = np.sort(at * WORDS + _word_ids(words))
            pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
            total[:WORDS] += np.bincount(pairs % WORDS, minlength=WORDS)
            total[WORDS] += rows.num_rows
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for s in range(SLICES):
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([squeeze(total[s::SLICES].astype("<i8").tobytes())], pa.binary())], ["slice", "sums"])

    def add(batches):
        import zstandard

        sums, unpack, squeeze = {}, zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for s, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[s] = sums.get(s, 0) + np.frombuffer(unpack(raw), "<i8")
        for s, one in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([squeeze(one.tobytes())], pa.binary())], ["slice", "sums"])

    import zstandard

    kind, total = "slice int, sums binary", np.zeros(WORDS + 1, np.int64)
    for r in texts.select("text").mapInArrow(count, kind).repartition(SLICES, "slice").mapInArrow(add, kind).collect():
        total[r["slice"] :: SLICES] += np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["sums"])), "<i8")
    return total


def inverse_frequencies(total: np.ndarray) -> np.ndarray:
    return (np.log((1 + total[WORDS]) / (1 + total[:WORDS])) + 1).astype(np.float32)


def weighted_shingles(buf: np.ndarray, offs: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and weight of each row's distinct shingles, by row and hash."""
    words, rows = _word_hashes(buf, offs)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.float32)
    n_words, by_word = B.per_row(rows, len(offs) - 1), idf[_word_ids(words)].astype(np.float64)
    sums = np.concatenate([[0], np.cumsum(by_word)])
    at = np.flatnonzero(B.whole_windows(rows, SHINGLE))
    hashes, mean, row = B.window_hashes(words, SHINGLE)[at], (sums[at + SHINGLE] - sums[at]) / SHINGLE, rows[at]
    few = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    if len(few):
        first = np.concatenate([[0], np.cumsum(n_words)])
        own = np.array([int.from_bytes(hashlib.blake2b(words[first[i] : first[i + 1]].tobytes(), digest_size=8).digest()) for i in few], U64)
        hashes, row = np.concatenate([hashes, own]), np.concatenate([row, few])
        mean = np.concatenate([mean, (sums[first[few + 1]] - sums[first[few]]) / n_words[few]])
    order = np.lexsort((hashes, row))
    hashes, mean, row = hashes[order], mean[order], row[order]
    new = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])]))
    times = np.diff(np.append(new, len(hashes)))
    return row[new], hashes[new], (mean[new] * times).astype(np.float32)


_draws: list[np.ndarray] = []


def draws() -> list[np.ndarray]:
    """Tables of 1 / r, r, ln c - r + r beta and beta."""
    if not _draws:
        rng = np.random.default_rng(5)
        r, c, beta = rng.gamma(2, 1, DRAWS), rng.gamma(2, 1, DRAWS), rng.random(DRAWS)
        _draws.extend(x.astype(np.float32) for x in (1 / r, r, np.log(c) - r + r * beta, beta))
    return _draws


def signatures(buf: np.ndarray, offs: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have shingles, and their SAMPLES samples each."""
    row, hashes, weight = weighted_shingles(buf, offs, idf)
    if not len(row):
        return np.zeros(0, np.int64), np.zeros((0, SAMPLES), U64)
    starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    sizes, log_weight = np.diff(np.append(starts, len(row))), np.log(weight)
    inverse, r, offset, beta = draws()
    out, local = np.empty((len(starts), SAMPLES), U64), np.repeat(np.arange(len(starts)), sizes)
    for k in range(SAMPLES):
        place = ((hashes * U64(2 * (k * 0x5851F42D4C957F2D + 0x14057B7EF767814F) % (1 << 64) + 1 & 0xFFFFFFFFFFFFFFFF)) >> U64(48)).astype(np.uint16)
        t = np.floor(log_weight * inverse[place] + beta[place])
        a = offset[place] - r[place] * t
        least = np.minimum.reduceat(a, starts)
        hit = np.flatnonzero(a == least[local])
        first = hit[np.concatenate([[True], local[hit[1:]] != local[hit[:-1]]])]
        out[:, k] = B.mix(hashes[first] ^ (t[first].astype(np.int64).astype(U64) * U64(0x9E3779B97F4A7C15) + U64(k)))
    return row[starts], out


def _sketches(idf):
    """key and signature rows of (key, text) rows, one for each key of a task's block."""

    def run(batches):
        for rows, buf, offs in B.blocks(batches, "text"):
            at, sketch = signatures(buf, offs, idf.value)
            width = SAMPLES * 2
            raw = pa.Array.from_buffers(pa.binary(width), len(at), [None, pa.py_buffer((sketch >> U64(48)).astype("<u2").tobytes())]).cast(pa.binary())
            bands = sketch.reshape(len(at), BANDS, ROWS)
            keys = bands[:, :, 0].copy()
            for j in range(1, ROWS):
                keys = B.mix(keys * B.WORD_BASE + bands[:, :, j])
            keys = B.mix(keys + np.arange(BANDS, dtype=U64) * U64(0xA0761D6478BD642F)).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(at)), raw, lists], ["key", "sketch", "bands"])

    return run


def _grouped(batches, n: int):
    """(key, rows) of consecutive rows with equal first n columns; a group may span batches."""
    held, key = [], None
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(n)]
        at = list(zip(*columns, strict=True))
        start = 0
        for i in range(1, len(at) + 1):
            if i == len(at) or at[i] != at[start]:
                if at[start] != key and held:
                    yield key, held
                    held = []
                key = at[start]
                held.append(batch.slice(start, i - start))
                start = i
    if held:
        yield key, held


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _stars(batches):
    """Stars of near signatures of each bucket. Rows: band, key, sketch, by band."""
    a, b = [], []
    for _, parts in _grouped(batches, 1):
        keys = [k for p in parts for k in p.column(1).to_pylist()]
        if len(keys) > 1:
            sketch = np.frombuffer(b"".join(s for p in parts for s in p.column(2).to_pylist()), "<u2").reshape(len(keys), SAMPLES)
            label = np.arange(len(keys))
            for i in range(len(keys) - 1):
                others = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
                near = others[(sketch[others] == sketch[i]).sum(1) >= NEAR * SAMPLES]
                if len(near):
                    label[np.isin(label, label[near])] = label[i]
            for x in np.unique(label):
                members = [keys[i] for i in np.flatnonzero(label == x)]
                least = min(members)
                a += [least] * (len(members) - 1)
                b += [m for m in members if m != least]
        if len(a) > 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def similar_links(data: list[bytes], idf: np.ndarray, least: float = SIMILAR, split: int | None = None) -> list[tuple[int, int]]:
    """Links that join all texts connected by pairs of weighted Jaccard similarity `least` or more; with split, only pairs across that index."""
    offs = np.cumsum([0, *map(len, data)])
    row, hashes, weight = weighted_shingles(np.frombuffer(b"".join(data), np.uint8), offs, idf)
    n, weight = len(data), weight.astype(np.float64)
    total = np.bincount(row, weight, n)
    order = np.lexsort((row, hashes))
    shingle = np.cumsum(np.concatenate([[0], hashes[order][1:] != hashes[order][:-1]])) if len(row) else np.zeros(0, np.int64)
    begin = np.searchsorted(shingle, np.arange(shingle[-1] + 2)) if len(row) else np.zeros(1, np.int64)
    holders, heavy = row[order], weight[order]
    of_entry = np.empty(len(row), np.int64)
    of_entry[order] = shingle
    place = np.empty(len(row), np.int64)
    place[order] = np.arange(len(row))
    first = np.searchsorted(row, np.arange(n + 1))
    parent, links = list(range(n)), []
    for i in range(n if split is None else split):
        mine = np.arange(first[i], first[i + 1])
        start, stop = (place[mine] + 1 if split is None else begin[of_entry[mine]]), begin[of_entry[mine] + 1]
        if split is not None:
            start = np.maximum(start, place[mine] + 1)
        count = stop - start
        if not (most := int(count.sum())):
            continue
        entries = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(most)
        shared = np.bincount(holders[entries], np.minimum(heavy[entries], np.repeat(weight[mine], count)), n)
        ok = shared >= (least - 1e-9) * (total[i] + total - shared)
        if split is not None:
            ok[:split] = False
        ok[i] = False
        for j in np.flatnonzero(ok & (shared > 0)).tolist():
            x, y = _find(parent, i), _find(parent, j)
            if x != y:
                parent[x] = y
                links.append((i, j))
    return links


def _verified(idf):
    """Links of each group. Rows: group, pair, side, key, text, by group and pair."""

    def run(batches):
        for _, parts in _grouped(batches, 2):
            sides = np.array([s for p in parts for s in p.column(2).to_pylist()])
            keys = [k for p in parts for k in p.column(3).to_pylist()]
            texts = [t.encode() for p in parts for t in p.column(4).to_pylist()]
            order = np.argsort(sides, kind="stable")
            keys, texts, split = [keys[i] for i in order], [texts[i] for i in order], int((sides == 0).sum())
            links = similar_links(texts, idf.value, split=split if split < len(keys) else None)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i, _ in links], pa.binary()), pa.array([keys[j] for _, j in links], pa.binary())], ["a", "b"])

    return run


def _packed(batches):
    """(key, packed) of (key, text) rows, one for each key of a task."""
    import zstandard

    squeeze, seen = zstandard.ZstdCompressor(level=3).compress, set()
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), B.text_column(batch, "text").cast(pa.binary())
        new = [i for i, k in enumerate(keys) if not (k in seen or seen.add(k))]
        yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in new], pa.binary()), pa.array([squeeze(texts[i].as_buffer()) for i in new], pa.binary())], ["key", "packed"])


def _unpacked(batches):
    """(group, key, text), one for each key; equal keys come in a row."""
    import zstandard

    unpack, before = zstandard.ZstdDecompressor().decompress, None
    for batch in batches:
        keys = batch.column(1).to_pylist()
        new = [i for i, k in enumerate(keys) if k != (keys[i - 1] if i else before)]
        before = keys[-1] if keys else before
        for at in range(0, len(new), 256):
            part = batch.take(pa.array(new[at : at + 256], pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([unpack(x).decode() for x in part.column(2).to_pylist()], pa.string())], ["group", "key", "text"])


def _groups(texts: DataFrame, groups: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """group, pair, side, key and text of every task's rows, and the tables that they read. A group of m blocks makes m (m + 1) / 2 pairs of blocks."""
    members = groups.select(F.col("node").alias("_key"), F.col("component").alias("group")).union(groups.select("component", "component").distinct())
    # By merge at every size: whether the members would fit a broadcast depends on the data, and a plan that changes with them needs more beyond.
    joined = texts.select("key", "text").mapInArrow(_packed, "key binary, packed binary").join(members.hint("merge"), F.col("key") == F.col("_key"))
    joined = written(joined.select("group", "key", "packed").mapInArrow(_unpacked, "group binary, key binary, text string"), "near-groups")
    sizes = joined.groupBy(F.col("group").alias("_group")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b"))
    blocks = F.greatest(F.ceil(F.col("n") / GROUP), F.ceil(F.col("b") / GROUP_BYTES), F.lit(1)).cast("int")
    sizes = written(sizes.select("_group", blocks.alias("m")), "near-sizes")  # a plain shuffle on both sides of the join, which adaptive execution can split
    dealt = joined.join(sizes, F.col("group") == F.col("_group"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("key"), F.col("m")).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("m") - 1),
        lambda j: F.struct((F.least("block", j) * F.col("m") + F.greatest("block", j)).alias("pair"), F.when(F.col("block") > j, 1).otherwise(0).alias("side")),
    )
    return dealt.select("group", F.explode(pairs).alias("p"), "key", "text").select("group", "p.pair", "p.side", "key", "text"), [joined, sizes]


def classes(texts: DataFrame) -> DataFrame:
    """node and component of every text in a class of two or more different texts, but the class's least. texts: key, text."""
    spark = texts.sparkSession
    idf = spark.sparkContext.broadcast(inverse_frequencies(document_frequencies(texts)))
    sketched = written(texts.select("key", "text").mapInArrow(_sketches(idf), "key binary, sketch binary, bands array<bigint>"), "near-sketches")
    once = written(sketched.groupBy("key").agg(F.first("sketch").alias("sketch"), F.first("bands").alias("bands")), "near-texts")
    banded = once.select("key", F.explode(F.array_distinct("bands")).alias("band"))
    shared = banded.groupBy(F.col("band").alias("_band")).agg(F.count(F.lit(1)).alias("_n"), F.min("key").alias("_least")).filter("_n > 1")
    shared = written(shared, "near-bands")
    buckets = written(banded.join(shared, F.col("band") == F.col("_band")).select("band", "key", "_n", "_least"), "near-buckets")
    small = buckets.filter(F.col("_n") <= BUCKET).select("band", "key").join(once.select(F.col("key").alias("_key"), "sketch"), F.col("key") == F.col("_key")).select("band", "key", "sketch")
    stars = small.repartition("band").sortWithinPartitions("band").mapInArrow(_stars, "a binary, b binary")
    # A larger bucket is one star, which needs no task to hold it.
    stars = stars.unionByName(buckets.filter(F.col("_n") > BUCKET).select(F.col("_least").alias("a"), F.col("key").alias("b")))
    groups = components(stars, "near-stars")
    dealt, read = _groups(texts, groups)
    found = components(dealt.repartition("group", "pair").sortWithinPartitions("group", "pair").mapInArrow(_verified(idf), "a binary, b binary"), "near-links")
    for table in (sketched, once, shared, buckets, groups, *read):
        removed(table)
    return found


def _keyed(docs: DataFrame, text: str) -> tuple:
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return F.unhex(F.md5(body.cast("binary"))).alias("key"), body.alias("text")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The id of every row with class_id, the least id of its class, and class_size in rows."""
    found = classes(docs.select(*_keyed(docs, text)))
    ids = docs.select(F.col(f"`{key}`").alias("_id"), _keyed(docs, text)[0])
    named = written(ids.join(found, F.col("key") == F.col("node"), "left").select("_id", F.coalesce("component", "key").alias("class")), "near-classes")
    sizes = named.groupBy(F.col("class").alias("_class")).agg(F.min("_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    sizes = written(sizes, "near-sizes")  # a plain shuffle on both sides of the join, which adaptive execution can split
    return named.join(sizes, F.col("class") == F.col("_class")).select(F.col("_id").alias(key), "class_id", "class_size")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, with its columns: that of the least id, nulls last."""
    names, row = docs.columns, unused(docs, "_row")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "near-rows")
    found = classes(numbered.select(*_keyed(numbered, text)))
    ids = numbered.select(F.col(f"`{key}`").alias("_id"), F.col(row).alias("_row"), _keyed(numbered, text)[0])
    named = ids.join(found, F.col("key") == F.col("node"), "left").select("_id", "_row", F.coalesce("component", "key").alias("class"))
    first = named.groupBy("class").agg(F.min(F.struct(F.col("_id").isNull().alias("n"), "_id", "_row")).alias("m")).select(F.col("m._row").alias(row))
    return numbered.join(first, row, "left_semi").select(*(F.col(f"`{c}`") for c in names))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
