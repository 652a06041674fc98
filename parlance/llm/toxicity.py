"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parlance.llm.common import cut, utf8

#: Hash space; the dense weights take 1 MB, the sparse ones that are broadcast far less.
DIM = 1 << 18
#: At most so many labelled documents are fitted on (those with the smallest id hashes).
FIT_ROWS = 12_000
#: Learning rate, its smoothing, L1, L2, passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 6.0, 1.0, 5
#: A feature takes part in fitting if so many sampled documents hold it.
LEAST_DOCS = 6
#: Score from which a text counts as toxic.
TOXIC = 0.3
#: Words whose hashes a task remembers, and texts whose bytes it copies at once.
REMEMBERED, AT_ONCE = 250_000, 256

#: Lower case, with ASCII punctuation as blanks.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def features(text: bytes, known: _Words) -> np.ndarray:
    """Hashed words, word pairs and pairs with one word skipped, as they come (with repeats)."""
    words = text.translate(_PLAIN).split()
    n = len(words)
    w = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    mult = np.uint64(0x9E3779B97F4A7C15)
    grams = [w * mult]
    for skip, salt in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
        if n > skip:
            grams.append((w[:-skip] * np.uint64(salt) + w[skip:]) * mult)
    return (np.concatenate(grams) >> np.uint64(46)).astype(np.int32)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(examples: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, float]:
    """Sparse weights (indices, values) and the bias of FTRL-proximal over (features, label) pairs."""
    z, n = np.zeros(DIM + 1), np.zeros(DIM + 1)
    often = np.zeros(DIM + 1, np.int64)
    for x, _ in examples:
        often[x] += 1
    for k, (x, y) in enumerate(examples):  # with the bias, which every example has
        examples[k] = np.append(x[often[x] >= LEAST_DOCS], np.int32(DIM)), y
    rng = np.random.default_rng(7)

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(ni)) / ALPHA + L2)

    for _ in range(PASSES):
        for k in rng.permutation(len(examples)):
            x, label = examples[k]
            zi, ni = z[x], n[x]
            w = weights(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = p - label
            n[x] = ni + g * g
            z[x] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
    w = weights(z, n)
    some = np.flatnonzero(w[:DIM])
    return some.astype(np.int32), w[some].astype(np.float32), float(w[DIM])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """A model learnt from a bounded sample of labelled documents that aren't held out.

    `rows` bounds the sample: ids are drawn from the labels by their hash, so only so many
    ids are broadcast and so many rows of feature indices reach the driver. Null texts count
    as empty; an id that repeats counts once, with its first text in order and its highest
    label. Without labelled rows the model scores 0 everywhere.
    """
    drawn = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    chosen = chosen.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    kind = chosen.schema["doc_id"].dataType.simpleString()

    def work(batches):
        known = _Words()
        for batch in batches:
            for i in range(batch.num_rows):
                x = np.unique(features((batch.column(1)[i].as_py() or "").encode(), known))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(2).slice(i, 1).cast(pa.int32()), pa.array([x.tobytes()])], ["doc_id", "toxic", "x"])

    found = cut(chosen.select("doc_id", "text", "toxic").mapInArrow(work, f"doc_id {kind}, toxic int, x binary"))
    # read row by row, so that the driver holds the sample once
    examples = sorted(((r["doc_id"], r["toxic"], np.frombuffer(bytes(r["x"]), np.int32)) for r in found.toLocalIterator()), key=lambda e: (e[0], e[1], len(e[2])))
    if not examples:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), -35.0
    return fit([(x, int(y > 0)) for _, y, x in examples])


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text", out: str = "toxic_score") -> DataFrame:
    """docs with `out` (0 to 1), replaced if there. Every text is read whole; null and empty texts get the bias alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    # only texts go to Python and only scores come back; the other columns wait in the JVM
    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        some, values, bias = sent.value
        dense = np.zeros(DIM, np.float32)
        dense[some] = values
        known = _Words()
        for texts in batches:
            total = np.full(len(texts), bias)
            for first in range(0, len(texts), AT_ONCE):
                data, offsets = utf8(texts.slice(first, AT_ONCE))
                for i in range(len(offsets) - 1):
                    x = features(data[offsets[i] : offsets[i + 1]].tobytes(), known)
                    x = np.unique(x[dense[x] != 0])
                    total[first + i] += float(dense[x].astype(np.float64).sum())
            yield pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))

    return docs.drop(out).withColumn(out, score(F.col(text)))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the documents that score TOXIC or more; all columns stay."""
    return score_toxicity(docs, train(docs, labels), out="__toxic").where(F.col("__toxic") < TOXIC).select(docs.columns)
