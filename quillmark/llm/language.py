"""Language identification with error-correcting output codes (operator 8).

Every language gets a codeword; for up to four languages all distinct splits are its bits, beyond that the best of some seeded random codes.
Each bit has a binary classifier over hashed byte n-grams of the lower-cased letters: naive Bayes log-odds between the languages whose
codewords have the bit and the others, from n-gram counts of all training texts, whole. A text's margin for a bit is the mean log-odds of its n-grams.
Decoding sums an exponential loss of the margins over the bits of each codeword, each bit weighted by how often its classifier was right for that
language on training rows, and takes the codeword with the least loss. A lead under AMBIGUOUS flags the text.

Fitting takes two Arrow passes without a shuffle of texts: tasks return sums of counts, FEATURES x languages at most, and then right answers by language and bit
over ACCURACY_ROWS hashed training rows at most (the bound on the decoding weights' sample). Predicting takes one.

Defined cases: null texts and texts without a letter are `und` with score 0; null langs are not learnt from, nor are rows with a null id,
whose held_out is false; without any training row all texts are `und`, with a single language all others are that one; of languages with equal losses the first by name is taken, flagged as ambiguous; texts of any length are read whole, a long one as a block of its own; further columns, whatever
their names, are never inputs; repeated rows count each; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import _blocks as B
from quillmark.llm._tables import add_struct, documents, unused

BITS = 15
FEATURES = 1 << BITS
LENGTHS = (3, 4)
SMOOTH = 0.5
SCALE = 4.0
AMBIGUOUS = 0.10
ACCURACY_ROWS = 20_000
UNKNOWN = "und"

#: ASCII letters lower-cased, other ASCII as a space, further bytes as they are.
LETTERS = np.where(np.arange(256) >= 128, np.arange(256), 32).astype(np.uint8)
LETTERS[97:123] = np.arange(97, 123)
LETTERS[65:91] = np.arange(97, 123)


def features(buf: np.ndarray, offs: np.ndarray, length: int) -> np.ndarray:
    """The hashed n-gram at each byte; FEATURES where it would leave the row or is white space alone."""
    b = LETTERS[buf].astype(np.uint32)
    if len(b) < length:
        return np.full(len(b), FEATURES, np.uint32)
    x = b.copy()
    for j in range(1, length):
        x[:-j] = (x[:-j] << np.uint32(8)) | b[j:]
    blank = x == int.from_bytes(b" " * length)
    out = (x * np.uint32(0x9E3779B1) + np.uint32(length)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)
    out[blank] = FEATURES
    for j in range(1, length):
        out[offs[1:][offs[1:] >= j] - j] = FEATURES
    return out


def codewords(n: int) -> np.ndarray:
    """Signs of each language's bits."""
    if n <= 4:
        splits = [s for k in range(1, n) for s in combinations(range(n), k) if 0 in s]
        code = -np.ones((n, len(splits)), np.int8)
        for bit, s in enumerate(splits):
            code[list(s), bit] = 1
        return code
    best, least, rng = None, -1, np.random.default_rng(11)
    for _ in range(200):
        code = np.where(rng.random((n, max(8, int(10 * np.log2(n))))) < 0.5, -1, 1).astype(np.int8)
        code = code[:, np.abs(code.sum(0)) < n]
        far = min(int((code[a] != code[b]).sum()) for a in range(n) for b in range(a))
        if far > least:
            best, least = code, far
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    #: (FEATURES + 1) x bits log-odds; the last row is nothing.
    weights: np.ndarray
    #: Languages x bits, rows sum to 1.
    trust: np.ndarray

    def margins(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        sums, grams = np.zeros((n, self.code.shape[1])), np.zeros(n)
        some = np.flatnonzero(offs[1:] > offs[:-1])
        for length in LENGTHS if len(some) else ():
            f = features(buf, offs, length)
            sums[some] += np.add.reduceat(self.weights[f], offs[some], 0)
            grams[some] += np.add.reduceat((f < FEATURES).astype(np.int64), offs[some])
        return sums / np.maximum(grams, 1)[:, None]

    def losses(self, margins: np.ndarray) -> np.ndarray:
        return np.stack([(self.trust[i] * np.exp(-np.clip(SCALE * margins * self.code[i], -30, 30))).sum(1) for i in range(len(self.languages))], 1)


def _counting(batches):
    """Sums of n-gram counts by language of a task."""
    sums: dict[str, np.ndarray] = {}
    for rows, buf, offs in B.blocks(batches, "text"):
        langs = rows.column(0).to_pylist()
        names = sorted(set(langs))
        number = {x: i for i, x in enumerate(names)}
        by_byte = np.repeat(np.array([number[x] for x in langs], np.int64), np.diff(offs)) * (FEATURES + 1)
        total = sum(np.bincount(by_byte + features(buf, offs, k), minlength=len(names) * (FEATURES + 1)) for k in LENGTHS)
        for x, one in zip(names, total.reshape(len(names), FEATURES + 1)[:, :FEATURES], strict=True):
            sums[x] = sums.get(x, 0) + one
    for x, one in sums.items():
        for part in range(16):
            yield pa.RecordBatch.from_arrays([pa.array([x]), pa.array([part], pa.int32()), pa.array([one[part :: 16].astype("<i8").tobytes()], pa.binary())], ["lang", "part", "sums"])


def _adding(batches):
    """The sums of equal language and part."""
    sums: dict[tuple, np.ndarray] = {}
    for batch in batches:
        for x, part, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sums[x, part] = sums.get((x, part), 0) + np.frombuffer(raw, "<i8")
    for (x, part), one in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([x]), pa.array([part], pa.int32()), pa.array([one.tobytes()], pa.binary())], ["lang", "part", "sums"])


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """A model of labelled rows; `key` only spreads the rows whose answers weight the decoding."""
    spark = rows.sparkSession
    own = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key).cast("string")).alias("spread")).filter("lang IS NOT NULL AND text IS NOT NULL")
    parts = "lang string, part int, sums binary"
    totals: dict[str, np.ndarray] = {}
    for r in own.select("lang", "text").mapInArrow(_counting, parts).repartition("lang", "part").mapInArrow(_adding, parts).collect():
        totals.setdefault(r["lang"], np.zeros(FEATURES))[r["part"] :: 16] = np.frombuffer(r["sums"], "<i8")
    languages = sorted(x for x, one in totals.items() if one.any())
    code = codewords(len(languages)) if languages else np.zeros((0, 0), np.int8)
    weights = np.zeros((FEATURES + 1, code.shape[1]), np.float32)
    shares = [(totals[x] + SMOOTH) / (totals[x] + SMOOTH).sum() for x in languages]
    for bit in range(code.shape[1]):
        ours, theirs = (np.mean([s for s, c in zip(shares, code[:, bit], strict=True) if c == sign], 0) for sign in (1, -1))
        weights[:FEATURES, bit] = np.log(ours) - np.log(theirs)
    model = Model(languages, code, weights, np.full(code.shape, 1 / max(1, code.shape[1])))
    if code.shape[1]:
        n = own.count()
        sample = own.filter(F.pmod("spread", F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1, ACCURACY_ROWS / max(1, n)))))
        shared = spark.sparkContext.broadcast(model)

        def right(batches):
            m, number = shared.value, {x: i for i, x in enumerate(shared.value.languages)}
            got, seen = np.zeros(m.code.shape), np.zeros(len(m.languages))
            for block, buf, offs in B.blocks(batches, "text"):
                i = np.array([number.get(x, -1) for x in block.column(0).to_pylist()])
                ok = (np.sign(m.margins(buf, offs)) == m.code[i])[i >= 0]
                np.add.at(got, i[i >= 0], ok)
                np.add.at(seen, i[i >= 0], 1)
            yield pa.RecordBatch.from_arrays([pa.array([got.tobytes()], pa.binary()), pa.array([seen.tobytes()], pa.binary())], ["got", "seen"])

        got, seen = np.ones(code.shape), np.ones(len(languages))
        for r in sample.select("lang", "text").mapInArrow(right, "got binary, seen binary").toLocalIterator():
            got += np.frombuffer(r["got"]).reshape(code.shape)
            seen += np.frombuffer(r["seen"])
        accuracy = got / seen[:, None]
        model.trust = accuracy / accuracy.sum(1, keepdims=True)
    return model


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep`, lang_pred, score and ambiguous of every row."""
    letter, kind = unused(docs, "_letter"), "lang string, score double, ambiguous boolean"
    rows = docs.withColumn(letter, F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decode(block: pa.RecordBatch, buf: np.ndarray, offs: np.ndarray) -> list:
        m, n, known = shared.value, len(offs) - 1, block.column(len(keep)).to_numpy(zero_copy_only=False)
        if not m.languages:
            return [pa.array([UNKNOWN] * n), np.zeros(n), np.zeros(n, bool)]
        if len(m.languages) == 1:
            return [pa.array([m.languages[0] if k else UNKNOWN for k in known], pa.string()), known.astype(float), np.zeros(n, bool)]
        losses = m.losses(m.margins(buf, offs))
        odds = 1 / losses
        ranked = np.sort(losses, 1)
        best = losses.argmin(1)
        close = (ranked[:, 1] - ranked[:, 0]) < AMBIGUOUS * ranked[:, 1]
        return [pa.array([m.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], pa.string()), np.where(known, odds.max(1) / odds.sum(1), 0.0), known & close]

    own = unused(rows, "_made")
    made = add_struct(rows, [*keep, letter], own, kind, decode, text)
    return made.select(*(F.col(f"`{c}`") for c in keep), F.col(f"{own}.lang").alias("lang_pred"), F.col(f"{own}.score").alias("score"), F.col(f"{own}.ambiguous").alias("ambiguous"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = fit(docs.filter(~held_out))
    marked = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return predict(marked, model, ["doc_id", "held_out"])
