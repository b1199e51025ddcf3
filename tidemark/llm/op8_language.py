"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's vector is the mean of the embeddings of its byte n-grams (hashed into buckets);
a linear layer and a softmax give language probabilities.  Embeddings and layer are
trained together by stochastic gradient descent in numpy.  A temperature, fitted on a
part of the sample that isn't trained on, calibrates the probabilities, and the same part
sets the rejection limit: the probability that all but KEEP of its right answers reach.

The fit uses a bounded sample: FIT_ROWS rows of at most FIT_CHARS characters from the
folds that are learned from, so FIT_ROWS languages at most.  Every text is classified as a whole.

Defined cases: null texts and texts without a letter are ``und`` with score 0; equal texts
have equal results, as do rows that repeat a doc_id or have none; a very long text is read
in windows of bounded size; rows without lang are classified but not learned from; with no
language to learn all texts are ``und``; of equally likely languages the first by name is
taken; an empty table gives no rows; other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import text_bytes, text_slices
from .grams import gram_ids, gram_sums
from .shared import fit_sample, fold

FIT_ROWS, FIT_CHARS = 3000, 6000
SIZES, BITS, WIDE = (2, 3, 4), 16, 16
EPOCHS, BATCH, STEP = 8, 16, 4.0
KEEP = 0.995
UNKNOWN = "und"


class Model(NamedTuple):
    languages: list[str]
    logits: np.ndarray  # of each bucket and language: embedding times layer
    bias: np.ndarray
    temperature: float
    limit: float


def _flat(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams with -1 for none, and the number of n-grams of each text."""
    ids = gram_ids(data, offsets, SIZES, BITS)
    counts = np.concatenate([[0], np.cumsum((ids >= 0).sum(axis=0))])
    return ids, counts[offsets[1:]] - counts[offsets[:-1]]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: pa.Array, languages: list[str]) -> Model:
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(0)
    y = np.array([names.index(x) for x in languages])
    data, offsets = text_bytes(texts)
    ids, counts = _flat(data, offsets)
    grams = [np.unique(own[own >= 0], return_counts=True) for own in (ids[:, a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True))]
    embedding = rng.normal(0, 0.1, (1 << BITS, WIDE))
    layer, bias = rng.normal(0, 0.1, (WIDE, len(names))), np.zeros(len(names))
    order = rng.permutation(len(y))
    check, learn = order[: len(y) // 5], order[len(y) // 5 :]
    mean = lambda i: (grams[i][1] @ embedding[grams[i][0]]) / max(1, counts[i])
    for epoch in range(EPOCHS):
        rng.shuffle(learn)
        step = STEP * (1 - epoch / EPOCHS)
        for at in range(0, len(learn), BATCH):
            rows = learn[at : at + BATCH]
            x = np.stack([mean(i) for i in rows])
            slope = softmax(x @ layer + bias)
            slope[np.arange(len(rows)), y[rows]] -= 1
            slope /= len(rows)
            back = slope @ layer.T
            layer -= step * (x.T @ slope)
            bias -= step * slope.sum(axis=0)
            for i, b in zip(rows, back, strict=True):
                own, n = grams[i]
                embedding[own] -= step * 10 * np.outer(n / max(1, counts[i]), b)
    if not len(check):
        check = learn
    z = np.stack([mean(i) for i in check]) @ layer + bias
    heats = np.geomspace(0.05, 20, 61)
    loss = [-np.log(softmax(z / t)[np.arange(len(check)), y[check]] + 1e-12).mean() for t in heats]
    heat = float(heats[int(np.argmin(loss))])
    p = softmax(z / heat)
    right = p.max(axis=1)[p.argmax(axis=1) == y[check]]
    limit = float(np.quantile(right, 1 - KEEP)) if len(right) else 0.0
    return Model(names, (embedding @ layer).astype(np.float32), bias, heat, limit)


def train(documents: DataFrame, most: int = FIT_ROWS, longest: int = FIT_CHARS) -> Model:
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0))
    sample = fit_sample(rows, "lang", most, longest)
    return fit(sample.column("text").combine_chunks(), sample.column("lang").to_pylist())


def has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (calibrated probability), rejected (score below the model's limit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [np.ones(len(model.logits), np.float32), *np.ascontiguousarray(model.logits.T)]
        letters = np.zeros(256, bool)
        letters[65:91] = letters[97:123] = True
        for rows, data, offsets in text_slices(batches, limit=1 << 20):
            counts, *totals = gram_sums(columns, data, offsets, offsets, SIZES, BITS)
            z = np.array(totals).T.reshape(rows.num_rows, -1) / np.maximum(counts, 1)[:, None] + model.bias
            plain = np.flatnonzero(letters[data])
            sure = np.searchsorted(plain, offsets[1:]) > np.searchsorted(plain, offsets[:-1])
            known = np.array([bool(s) or has_letter(data[a:b].tobytes()) for s, a, b in zip(sure, offsets[:-1], offsets[1:], strict=True)], bool) & bool(model.languages)
            if model.languages:
                p = softmax(z / model.temperature)
                best, sc = p.argmax(axis=1), p.max(axis=1)
            else:
                best, sc = np.zeros(rows.num_rows, int), np.zeros(rows.num_rows)
            names = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
            sc = np.where(known, sc, 0.0)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(names, pa.string()), pa.array(sc), pa.array(~known | (sc < model.limit))], ["doc_id", "lang_pred", "score", "rejected"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def query(spark, sf_dir: str) -> DataFrame:
    from .shared import table

    documents = table(spark, sf_dir, "documents")
    return identify(documents, train(documents)).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "rejected")
