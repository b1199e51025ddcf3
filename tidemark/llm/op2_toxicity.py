"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence's logit is a fixed bias plus the weights of its hashed byte n-grams.  A document is
toxic unless all its sentences are clean (noisy-or): P = 1 - prod(1 - p).  The gradient of
the documents' likelihood trains the sentence model, which then locates the offending
sentences of a toxic document.

The fit uses a bounded sample: FIT_ROWS labelled rows of at most FIT_CHARS characters, from
the folds that are learned from.  Every document is scored, over its whole text.

Defined cases: null and empty texts score 0; texts without labels are scored alike; equal
texts have equal scores; rows that repeat a doc_id, or have none, stay or go by their own
text; a very long text is scored in windows of bounded size; labels that are null, or of
documents that don't exist, aren't used; of repeated labels of a document one counts (toxic
wins); without any label all scores are next to 0, and with one class only those of texts
that aren't empty are next to that class (0 or 1); an empty table gives no rows; other
columns don't matter, whatever their names, and ``remove_toxic`` keeps them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import text_bytes, text_slices
from .grams import gram_ids, gram_sums, sentences, sums
from .shared import fit_sample, fold

FIT_ROWS, FIT_CHARS = 3000, 6000
SIZES, BITS = (4, 5, 6), 18
EPOCHS, BATCHES, STEP, SPARSE, BIAS = 24, 8, 0.5, 1e-4, -9.0
LIMIT = 0.5
SLICE = 2 << 20  # bytes of text scored at once


def _features(data: np.ndarray, offsets: np.ndarray):
    ids = gram_ids(data, offsets, SIZES, BITS)
    ids[ids < 0] = 1 << BITS  # a bucket without weight
    return ids, *sentences(data, offsets)


def _logits(weights: np.ndarray, ids: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return weights[-1] + sums(weights[ids].sum(axis=0), edges)


def _clean(logits: np.ndarray) -> np.ndarray:
    """-log(1 - p) of each sentence."""
    return np.logaddexp(0, logits)


def fit(texts: pa.Array, toxic: np.ndarray) -> np.ndarray:
    """Weights of the buckets, a zero, and the bias, by proximal Adagrad on batches of documents.

    The L1 term leaves a few thousand weights, and the bias is fixed so low that thousands of ordinary sentences stay clean together."""
    weights = np.zeros((1 << BITS) + 2)
    weights[-1] = BIAS
    if not len(toxic) or toxic.min() == toxic.max():
        weights[-1] = 30.0 if len(toxic) and toxic[0] else -60.0
        return weights
    order = np.random.default_rng(0).permutation(len(toxic))
    batches = []
    for part in np.array_split(order, BATCHES):
        data, offsets = text_bytes(texts.take(pa.array(part)))
        batches.append((*_features(data, offsets), toxic[part].astype(float)))
    square = np.full(len(weights), 1e-8)
    for _ in range(EPOCHS):
        for ids, edges, first, y in batches:
            z = _logits(weights, ids, edges)
            p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
            whole = -np.expm1(-sums(_clean(z), first))
            pull = np.where(y > 0, (1 - whole) / np.maximum(whole, 1e-9), -1.0)
            spread = np.repeat(p * np.repeat(pull, np.diff(first)) / len(y), np.diff(edges))
            slope = np.zeros(len(weights))
            for row in ids:
                slope += np.bincount(row, spread, len(weights))
            slope[-2:] = 0
            square += slope * slope
            rate = STEP / np.sqrt(square)
            weights += rate * slope
            weights[:-2] = np.sign(weights[:-2]) * np.maximum(np.abs(weights[:-2]) - rate[:-2] * SPARSE, 0)
    return weights


def train(documents: DataFrame, labels: DataFrame, most: int = FIT_ROWS, longest: int = FIT_CHARS) -> np.ndarray:
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    sample = fit_sample(known.filter(fold(F.col("doc_id")) != 0), "toxic", most, longest, rows)
    return fit(sample.column("text").combine_chunks(), sample.column("toxic").to_numpy())


def sentence_scores(weights: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores of the documents; edges of the sentences, the first sentence of each document, and the sentences' scores."""
    edges, first = sentences(data, offsets)
    z = weights[-1] + gram_sums([weights[:-2]], data, offsets, edges, SIZES, BITS)[0]
    return np.clip(-np.expm1(-sums(_clean(z), first)), 0.0, 1.0), edges, first, 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def score(documents: DataFrame, weights: np.ndarray, limit: float = LIMIT) -> DataFrame:
    """doc_id, score, toxic_sentences (start and end in code points, score, text) of each document."""
    held = weights.astype(np.float32)
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, limit=SLICE):
            whole, edges, first, p = sentence_scores(held, data, offsets)
            found = []
            for i in range(rows.num_rows):
                own = []
                if whole[i] >= limit:
                    raw, done, before = data[offsets[i] : offsets[i + 1]].tobytes(), 0, 0
                    for s in np.flatnonzero(p[first[i] : first[i + 1]] >= limit / 2) + first[i]:
                        a, b = int(edges[s] - offsets[i]), int(edges[s + 1] - offsets[i])
                        part, before, done = raw[a:b].decode(), before + len(raw[done:a].decode()), a
                        own.append({"start": before, "end": before + len(part), "score": float(p[s]), "text": part})
                found.append(own)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(whole), pa.array(found, pa.list_(kind))], ["doc_id", "score", "toxic_sentences"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double, toxic_sentences array<struct<start: long, end: long, score: double, text: string>>")


def remove_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted toxic, with all their columns: a row is judged where it is read, so none moves."""
    held = train(documents, labels).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, limit=SLICE):
            yield rows.filter(pa.array(sentence_scores(held, data, offsets)[0] < LIMIT))

    return documents.mapInArrow(run, documents.schema)


def query(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    documents = table(spark, sf_dir, "documents")
    scored = score(documents, train(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"), F.size("toxic_sentences").alias("n_toxic_sentences"))
