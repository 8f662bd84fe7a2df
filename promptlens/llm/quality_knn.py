"""Quality classifier: nearest-neighbour voting in a latent semantic space.

Texts are TF-IDF vectors of hashed byte trigrams, with the share of words that repeat the
word before them as one more coordinate, projected by a truncated singular value decomposition that is fitted on a bounded sample of labelled documents. The sample's
latent vectors and labels are broadcast; every document is compared with all of them in
exact blocked cosine products, and its nearest neighbours vote with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptlens.llm.batches import IS_SPACE, slices, span_hashes
from promptlens.llm.common import written

# Bounds of what is learned and broadcast: expected sample documents, hashed features, latent dimensions.
SAMPLE_DOCS, FEATURES, LATENT = 2000, 8192, 64
# Counts are FEATURES trigrams, then words and words equal to the one before.
COUNTS = FEATURES + 2
NEIGHBOURS, POWER = 5, 4
THRESHOLD = 0.3
# Texts are counted up to this many bytes at a time, and compared in blocks of so many documents.
BYTES, BLOCK = 1 << 21, 128


@dataclass
class Model:
    idf: np.ndarray
    basis: np.ndarray  # (FEATURES + 1, LATENT)
    vectors: np.ndarray  # (sample, LATENT), of length 1
    labels: np.ndarray
    prior: float


def trigrams(texts: list[str]) -> np.ndarray:
    """(texts, COUNTS): hashed byte trigrams, words, repeating words; a text is padded by a space on both sides."""
    out = np.zeros((len(texts), COUNTS), np.float32)
    for lo, hi, raw in _byte_blocks(texts):
        text = np.frombuffer(b"".join(raw), np.uint8)
        row = np.repeat(np.arange(hi - lo), [len(r) for r in raw])
        if len(text) < 3:
            continue
        part = text.astype(np.uint32)
        h = (part[:-2] << np.uint32(16) | part[1:-1] << np.uint32(8) | part[2:]) * np.uint32(2654435769)
        at = row[:-2] * FEATURES + (h >> np.uint32(32 - FEATURES.bit_length() + 1))
        at = at[row[:-2] == row[2:]]
        out[lo:hi, :FEATURES] += np.bincount(at, minlength=(hi - lo) * FEATURES).reshape(hi - lo, FEATURES)
        space = np.concatenate(([True], IS_SPACE[text], [True]))
        start, end = (np.flatnonzero(x) for x in (space[:-1] & ~space[1:], ~space[:-1] & space[1:]))
        words, of = span_hashes(text, start, end), row[start]
        again = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
        out[lo:hi, FEATURES] += np.bincount(of, minlength=hi - lo)
        out[lo:hi, FEATURES + 1] += np.bincount(of[1:][again], minlength=hi - lo)
    return out


def _byte_blocks(texts: list[str]) -> Iterator[tuple[int, int, list[bytes]]]:
    block: list[bytes] = []
    size, lo = 0, 0
    for i, t in enumerate(texts):
        raw = b" " + t.encode("utf-8", "surrogatepass") + b" "
        if block and size + len(raw) > BYTES:
            yield lo, i, block
            block, size, lo = [], 0, i
        while len(raw) > BYTES:  # a very long text in overlapping parts, whose trigrams add up
            yield i, i + 1, [raw[:BYTES]]
            raw = raw[BYTES - 2:]
        block.append(raw)
        size += len(raw)
    if block:
        yield lo, len(texts), block


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = _unit(np.log1p(counts[:, :FEATURES]) * idf)
    return np.hstack((x, counts[:, FEATURES + 1:] / np.maximum(counts[:, FEATURES:-1], 1)))


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(norm > 0, norm, 1)).astype(np.float32)


def fit(counts: np.ndarray, labels: np.ndarray) -> Model:
    """The model of sample ``counts`` (rows of trigram counts) and their labels 0/1."""
    n = len(labels)
    idf = (np.log((1 + n) / (1 + (counts[:, :FEATURES] > 0).sum(axis=0))) + 1).astype(np.float32)
    x = _weighted(counts, idf)
    r = min(LATENT, max(1, n))
    # Randomised range finder with power steps, then an exact decomposition of the small rest.
    q = np.random.default_rng(11).standard_normal((FEATURES + 1, r + 16), np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    basis = (q @ vt[:r].T).astype(np.float32)
    return Model(idf, basis, _unit(x @ basis), labels.astype(np.float32), float(labels.mean()) if n else 0.5)


def vote(counts: np.ndarray, model: Model) -> np.ndarray:
    """Share of label 1 among the nearest neighbours, weighted by powers of their cosines.

    A text that is similar to none (an empty one, say) has the sample's share.
    """
    if not len(model.labels):
        return np.full(len(counts), model.prior)
    cos = np.maximum(_unit(_weighted(counts, model.idf) @ model.basis) @ model.vectors.T, 0)
    k = min(NEIGHBOURS, cos.shape[1])
    near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    w = np.take_along_axis(cos, near, axis=1).astype(np.float64) ** POWER
    total = w.sum(axis=1)
    # One neighbour's worth of the prior keeps sparse votes away from 0 and 1.
    return np.where(total > 0, ((w * model.labels[near]).sum(axis=1) + 1e-3 * model.prior) / (total + 1e-3), model.prior)


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """The model of a hash sample of ``labels`` (doc_id, label 0/1), ``sample_docs`` of them as expected, with their texts in ``docs``."""
    slots = 1 << 30
    labels = labels.groupBy("doc_id").agg(F.max("label").alias("label"))
    rate = min(slots, int(slots * sample_docs / max(labels.count(), 1)))
    chosen = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(slots)) < rate)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for of, texts in slices(iter([b])):
                raw = [row.astype(np.float32).tobytes() for row in trigrams(texts)]
                yield pa.RecordBatch.from_arrays([pa.array([x["doc_id"] for x in of], pa.int64()), pa.array([x["label"] for x in of], pa.int64()), pa.array(raw, pa.binary())],
                                                 names=["doc_id", "label", "counts"])

    # The chosen ids are as few as the sample, so the texts need not move before they are chosen; an id teaches one text.
    picked = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select(F.struct("doc_id", "label").alias("of"), "text")
    rows = written(picked.mapInArrow(count, "doc_id long, label long, counts binary"), "quality-sample").orderBy("doc_id").collect()
    counts = np.stack([np.frombuffer(r.counts, np.float32) for r in rows]) if rows else np.zeros((0, COUNTS), np.float32)
    return fit(counts, np.array([r.label for r in rows]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            scores = [vote(trigrams(texts[lo:lo + BLOCK]), shared.value) for lo in range(0, len(texts), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.clip(np.concatenate(scores), 0, 1), pa.float64())], names=["doc_id", "score"])

    return docs.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
             threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Labels are learned only from rows that are not held out (crc32 of the id mod 5 is not 0);
    null labels, labels other than 0 and 1, and labels whose document is missing, teach nothing;
    of an id with several texts the first in order teaches, one with both labels counts as 1. A null or empty text
    is similar to no other and scores the sample's share of label 1 (0.5 without labels), as
    does every text where there are no labels. Repeated rows get equal scores; an empty table
    gives no rows; other columns are not read.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("long").alias("label")).where("label in (0, 1)")
    model = learn(own, known.where(~held_out()))
    return score(own, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                                    (F.col("score") >= threshold).cast("int").alias("predicted"))
