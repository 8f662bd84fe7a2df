"""Language ID by language-bitmask n-gram filters.

A Bloom filter per language, stored bit-sliced: slot i of the table holds one bit for
every language, so ANDing the slots of an n-gram's hashes returns all languages that contain
it at once. A text's n-grams are counted per language; each count is corrected for the
false positives that the language's fill rate predicts, and the largest decides.

The filters are learned from a bounded sample of labelled documents. N-grams go into the
filters of the languages where they are typical: nearly as frequent as where they are
most frequent.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptlens.llm.batches import mixed, slices
from promptlens.llm.common import written

UNDETERMINED = "und"
# Bounds of what is learned: expected sample documents and n-grams per language.
SAMPLE_DOCS, GRAMS = 3000, 20_000
SIZES = (1, 2, 3, 4)
SLOTS, HASHES = 1 << 20, 2
# An n-gram is typical of a language if seen so often, and with this share of its highest relative frequency.
MIN_COUNT, TYPICAL = 3, 0.25
SPACE = 32
MULTIPLIERS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


@dataclass
class Filters:
    """``slots``: (SLOTS, words) longs, one bit per language; ``false_rate``: of each language."""

    languages: list[str]
    slots: np.ndarray
    false_rate: np.ndarray


_LETTERS: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTERS[0]


def n_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash) of all n-grams of all texts, and whether each text has a letter.

    Letters are lower-cased, each run of other characters is one space; n-grams do not span it
    but may begin or end with it.
    """
    low = [t.lower() + "\n" for t in texts]
    sizes = np.fromiter(map(len, low), np.int64, len(low))
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letter_table()[codes]
    doc = np.repeat(np.arange(len(low), dtype=np.int32), sizes)
    any_letter = np.bincount(doc[letter], minlength=len(low)) > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of other characters, the first after a letter
    codes, doc = np.where(letter, codes, SPACE)[keep].astype(np.uint64), doc[keep]
    inner = codes == SPACE
    out_doc, out_hash = [], []
    for n in SIZES:
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = np.full(m, n, np.uint64)
        for i in range(n):
            h += (codes[i:m + i] + np.uint64(1)) * MULTIPLIERS[i]
        ok = doc[:m] == doc[n - 1:]
        for i in range(1, n - 1):
            ok &= ~inner[i:m + i]
        if n == 1:
            ok &= ~inner
        if n == 2:
            ok &= ~(inner[:m] & inner[1:m + 1])
        out_doc.append(doc[:m][ok])
        out_hash.append(mixed(h[ok]))
    if not out_doc:
        return np.empty(0, np.int32), np.empty(0, np.uint64), any_letter
    return np.concatenate(out_doc), np.concatenate(out_hash), any_letter


def _addresses(h: np.ndarray) -> list[np.ndarray]:
    step = np.uint64(SLOTS.bit_length() - 1)
    return [((h >> (np.uint64(k) * step)) % np.uint64(SLOTS)).astype(np.int64) for k in range(HASHES)]


def make_filters(grams: dict[str, np.ndarray]) -> Filters:
    languages = sorted(grams)
    words = max(1, -(-len(languages) // 64))
    slots = np.zeros((SLOTS, words), np.uint64)
    rate = np.zeros(len(languages))
    for i, name in enumerate(languages):
        bit = np.uint64(1 << (i % 64))
        for at in _addresses(grams[name]):
            slots[at, i // 64] |= bit
        rate[i] = np.count_nonzero(slots[:, i // 64] & bit) / SLOTS
    return Filters(languages, slots, rate ** HASHES)


def classify(texts: list[str], f: Filters) -> tuple[list[str], np.ndarray]:
    doc, h, any_letter = n_grams(texts)
    total = np.bincount(doc, minlength=len(texts)).astype(float)
    at = _addresses(h)
    counts = np.zeros((len(f.languages), len(texts)))
    for w in range(f.slots.shape[1] if f.languages else 0):
        mask = f.slots[at[0], w]
        for a in at[1:]:
            mask = mask & f.slots[a, w]
        for i in range(64 * w, min(64 * w + 64, len(f.languages))):
            counts[i] = np.bincount(doc, (mask >> np.uint64(i % 64)) & np.uint64(1), len(texts))
    if not f.languages:
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    rate = f.false_rate[:, None]
    counts = np.maximum(0.0, (counts - total * rate) / (1 - rate))
    best = counts.argmax(axis=0)
    share = np.where(total > 0, counts.max(axis=0) / np.maximum(total, 1), 0.0)
    known = [f.languages[b] if ok else UNDETERMINED for b, ok in zip(best, any_letter)]
    return known, np.where(any_letter, np.clip(share, 0, 1), 0.0)


def learn(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS, max_grams: int = GRAMS) -> Filters:
    """Filters from rows (doc_id, text, lang); texts and languages are not null.

    A language with more than ``sample_docs`` documents is sampled by the hash of the id, at
    the rate that its count over all documents gives.
    """
    spark: SparkSession = labelled.sparkSession
    slots = 1 << 30
    rates = labelled.groupBy("lang").agg(F.least(F.lit(slots), F.floor(F.lit(float(sample_docs) * slots) / F.count("*"))).alias("rate"))
    sample = labelled.join(F.broadcast(rates), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(slots)) < F.col("rate"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in slices(batches):
            doc, h, _ = n_grams(texts)
            names = sorted(set(langs))
            number = np.fromiter((names.index(x) for x in langs), np.int64, len(langs))
            of = number[doc] if len(doc) else np.empty(0, np.int64)
            for i, name in enumerate(names):
                g, n = np.unique(h[of == i], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n, pa.int64())],
                                                 names=["lang", "gram", "n"])

    found = sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = written(found, "language-grams")
    share = found.join(F.broadcast(found.groupBy("lang").agg(F.sum("n").alias("all"))), "lang").withColumn("p", F.col("n") / F.col("all"))
    top = share.groupBy("gram").agg(F.max("p").alias("top"))
    typical = share.join(top, "gram").where((F.col("n") >= MIN_COUNT) & (F.col("p") >= TYPICAL * F.col("top")))
    # At most ``max_grams`` per language come to the driver, whatever the corpus.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = typical.select("lang", "gram", rank.alias("rank")).where(F.col("rank") <= max_grams).groupBy("lang").agg(F.collect_list("gram").alias("grams")).collect()
    return make_filters({r[0]: np.array(r[1], np.int64).view(np.uint64) for r in rows})


def predict(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score (share of the n-grams that the language contains)."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            lang, score = classify(texts, shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1


# A text whose n-grams its best language contains to a smaller share is in none of the learned languages.
MIN_SCORE = 0.4


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` less the rows that are ``und`` or score under ``min_score``; all columns, no row moves.

    Without any labelled row no language is known that a text could fail to be in: then only
    rows whose text is null or has no letter go.
    """
    filters = learn(_learnable(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))))
    shared, at = docs.sparkSession.sparkContext.broadcast(filters), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep: list[bool] = []
            for _, texts in slices(iter([pa.RecordBatch.from_arrays([b.column(at), b.column(at)], names=["id", "text"])])):
                if not shared.value.languages:
                    keep += n_grams(texts)[2].tolist()
                    continue
                lang, score = classify(texts, shared.value)
                keep += [x != UNDETERMINED and s >= min_score for x, s in zip(lang, score)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def _learnable(own: DataFrame) -> DataFrame:
    return own.where(~held_out() & F.col("text").isNotNull() & F.col("lang").isNotNull())


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Learns from the text and language of rows that are not held out (crc32 of the id mod 3
    is not 1); a null id counts as not held out but is not learned from. A null text or one
    without a letter is ``und`` with score 0; with nothing to learn from, every text is. Ties
    go to the first language by name. Repeated rows get equal results, an empty table none;
    other columns are not read.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    filters = learn(_learnable(own))
    return predict(own, filters).withColumn("held_out", F.coalesce(held_out(), F.lit(False))).select("doc_id", "held_out", "lang_pred", "score")
