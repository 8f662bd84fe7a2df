"""Source divergence audit over a frequent-pattern tree of term rows.

Each language keeps its frequent terms. A term's row is its nonzero counts by source, in
source order; rows are the transactions of a frequent-pattern tree, equal rows once with
their multiplicity. The divergence of two sources starts from the terms that neither holds,
which are only counted, and is corrected by the tree: a node corrects for its source alone,
a node with an ancestor for the pair, once per combination with the node's multiplicity.
Sorted rows are dealt over tasks, and each batch of them is a tree of its own: corrections
add up, so a node that two batches share is right whatever the cut.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptlens.llm.common import written

MIN_DOCS, SCALE, TOP_TERMS = 3, 10 ** 9, 200
# Counts of a task are handed on from so many distinct (lang, source, term), or bytes of terms, on.
HELD_TERMS, HELD_BYTES = 400_000, 64 << 20
# Node-ancestor combinations are corrected up to this many at a time.
COMBINATIONS = 1 << 20

# Bytes of terms: letters A-Z in lower case, a-z and all of the multi-byte characters; the rest separates.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) summed over a bounded number of documents of a task; input is (lang, source, text)."""
    held: dict[tuple[str, str, bytes], list[int]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        keys = list(held)
        for lo in range(0, len(keys), 50_000):
            part = keys[lo:lo + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in part], pa.string()), pa.array([k[1] for k in part], pa.string()), pa.array([k[2].decode() for k in part], pa.string()),
                 pa.array([held[k][0] for k in part], pa.int64()), pa.array([held[k][1] for k in part], pa.int64())],
                names=["lang", "source", "term", "n", "docs"])

    for b in batches:
        for lang, source, text in zip(*(b.column(i).to_pylist() for i in range(3))):
            own: dict[bytes, int] = defaultdict(int)
            for t in (text or "").encode().translate(_FOLD).split():
                own[t] += 1
            for t, n in own.items():
                key = (lang, source, t)
                if (c := held.get(key)) is None:
                    held[key] = [n, 1]
                    size += len(t)
                else:
                    c[0] += n
                    c[1] += 1
            if len(held) >= HELD_TERMS or size >= HELD_BYTES:
                yield from flush()
                held, size = {}, 0
    yield from flush()


@dataclass
class Tree:
    """Nodes of a frequent-pattern tree, parents before children; a root's parent is -1."""

    parent: np.ndarray
    source: np.ndarray
    p: np.ndarray
    weight: np.ndarray


def build_tree(sources: np.ndarray, p: np.ndarray, starts: np.ndarray, weights: np.ndarray) -> Tree:
    """The tree of rows (``starts`` has one more entry than rows) with multiplicities ``weights``.

    Neighbouring rows share the nodes of their common beginning; sorted rows share all they can.
    """
    length = np.diff(starts)
    at = np.full(len(length), -1, np.int64)
    parts: list[tuple[np.ndarray, ...]] = []
    n = 0
    for depth in range(int(length.max(initial=0))):
        rows = np.flatnonzero(length > depth)
        own, s, x = at[rows], sources[starts[rows] + depth], p[starts[rows] + depth]
        new = np.ones(len(rows), bool)
        new[1:] = (own[1:] != own[:-1]) | (s[1:] != s[:-1]) | (x[1:] != x[:-1])
        first = np.flatnonzero(new)
        parts.append((own[first], s[first], x[first], np.add.reduceat(weights[rows], first)))
        at[rows] = n + np.cumsum(new) - 1
        n += len(first)
    if not parts:
        return Tree(*(np.empty(0, np.int64) for _ in range(4)))
    return Tree(*(np.concatenate(c) for c in zip(*parts)))


def _term(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _sums(a: np.ndarray, b: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((b, a))
    a, b, value = a[order], b[order], value[order]
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    return a[first], b[first], np.add.reduceat(value, first)


def corrections(tree: Tree, zero: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(source, item, value) sums over the tree's node-ancestor combinations, both ways round.

    ``zero`` holds the p of a count of 0 by source. With g for the pair's term, the correction
    is g(p, p') - g(p, zero') - g(zero, p') + g(zero, zero'), times the node's multiplicity.
    """
    for lo in range(0, len(tree.parent), COMBINATIONS):
        node = np.arange(lo, min(lo + COMBINATIONS, len(tree.parent)))
        up = tree.parent[node]
        while len(node := node[up >= 0]):
            up = up[up >= 0]
            a, b, x, y, w = tree.source[node], tree.source[up], tree.p[node], tree.p[up], tree.weight[node]
            zx, zy = zero[a], zero[b]
            there = w * (_term(x, y) - _term(x, zy) - _term(zx, y) + _term(zx, zy))
            back = w * (_term(y, x) - _term(zy, x) - _term(y, zx) + _term(zy, zx))
            yield _sums(np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((there, back)))
            up = tree.parent[up]


def tree_corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, value) of sorted rows (lang, zero, path of (source, p), m), a tree for each language of a batch."""
    for batch in batches:
        lang = batch.column(0).to_pylist()
        cut = [0, *(i for i in range(1, len(lang)) if lang[i] != lang[i - 1]), len(lang)]
        for lo, hi in zip(cut, cut[1:]):
            if lo == hi:
                continue
            zero = batch.column(1).slice(lo, 1).flatten().to_numpy(zero_copy_only=False)
            path = batch.column(2).slice(lo, hi - lo)
            offsets = path.offsets.to_numpy().astype(np.int64)
            items = path.flatten()
            tree = build_tree(items.field(0).to_numpy(zero_copy_only=False).astype(np.int64), items.field(1).to_numpy(zero_copy_only=False),
                              offsets - offsets[0], batch.column(3).slice(lo, hi - lo).to_numpy(zero_copy_only=False))
            for a, b, value in corrections(tree, zero):
                yield pa.RecordBatch.from_arrays([pa.array([lang[lo]] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(value, pa.int64())],
                                                 names=["lang", "a", "b", "value"])


def share(x: Column, d: Column) -> Column:
    """1 + floor(SCALE * x / d), exact in 64 bits for x <= d < 9 * 10^15: a thousandfold digit at a time."""
    whole, rest = F.lit(0).cast("long"), x
    for _ in range(3):
        digit = rest * 1000
        whole, rest = whole * 1000 + F.call_function("div", digit, d), digit % d
    return whole + 1


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
          min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from the others of its language, and by which terms.

    Part ``pair`` has every other source of the language as item and the divergence over all
    kept terms as value; part ``term`` the ``top`` terms that the group holds above its
    language's share. Ranks go by value downwards, then by item. Null text, lang and source
    are empty strings; repeated rows count each; a language without kept terms has pairs of
    value 0; an empty table gives no rows; other columns are not read. A term longer than
    others is kept whole.
    """
    part = lambda c: F.coalesce(F.col(c), F.lit(""))
    docs = docs.select(part(lang_col).alias("lang"), part(source_col).alias("source"), part(text_col).alias("text"))
    groups = docs.groupBy("lang", "source").agg(F.lit(1).alias("one"))
    # The sources of a language by number: as many rows as groups.
    groups = written(groups.groupBy("lang").agg(F.sort_array(F.collect_list("source")).alias("sources")).select("lang", F.posexplode("sources").alias("i", "source")), "divergence-groups")
    counts = docs.mapInArrow(term_counts, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # A row holds at most one entry for each source of the language.
    rows = written(counts.join(groups, ["lang", "source"]).groupBy("lang", "term")
                   .agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", F.col("n").alias("c")))).alias("row"))
                   .where(F.col("docs") >= min_docs).select("lang", "term", "n", "row"), "divergence-rows")
    held = rows.select("lang", F.inline("row")).groupBy("lang", "i").agg(F.sum("c").alias("own"))
    langs = rows.groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("all"))
    stats = groups.join(held, ["lang", "i"], "left").join(langs, "lang", "left").select("lang", "i", "source", F.coalesce("own", F.lit(0)).alias("own"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("all", F.lit(0)).alias("all"))
    some = F.col("v") > 0
    stats = written(stats.withColumn("zero", F.when(some, share(F.lit(1).cast("long"), F.col("own") + F.col("v"))).otherwise(1)), "divergence-stats")
    by_lang = written(stats.groupBy("lang").agg(F.max("v").alias("v"), F.max("all").alias("all"), F.transform(F.sort_array(F.collect_list(F.struct("i", "own", "zero"))), lambda s: s["own"]).alias("owns"),
                                                F.transform(F.sort_array(F.collect_list(F.struct("i", "own", "zero"))), lambda s: s["zero"]).alias("zeros")), "divergence-langs")
    # Shares in place of counts; q is the language's own share of the term.
    path = F.transform("row", lambda e: F.struct(e["i"].alias("i"), share(e["c"] + 1, F.get("owns", e["i"]) + F.col("v")).alias("p")))
    shares = rows.join(by_lang, "lang").select("lang", "term", "zeros", path.alias("path"), share(F.col("n") + 1, F.col("all") + F.col("v")).alias("q"))
    shares = written(shares, "divergence-shares")

    best = Window.partitionBy("lang", "i").orderBy(F.desc("value"), "term")
    terms = shares.select("lang", "term", "q", F.inline("path")).where("p > q").select("lang", "i", "term", _f(F.col("p"), F.col("q")).alias("value")) \
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    terms = terms.join(stats.select("lang", "i", "source"), ["lang", "i"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

    paths = shares.groupBy("lang", "zeros", "path").agg(F.count("*").alias("m"))
    ordered = paths.repartitionByRange("lang", "path").sortWithinPartitions("lang", "path").select("lang", "zeros", "path", "m")
    both = ordered.mapInArrow(tree_corrections, "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("both"))
    # A node's own correction depends on its source, its share and the other source's zero alone.
    single = shares.select("lang", F.inline("path")).groupBy("lang", "i", "p").agg(F.count("*").alias("m"))
    a, b = (stats.select("lang", *[F.col(c).alias(f"{k}_{c}") for c in ("i", "source", "zero")], *(["v"] if k == "a" else [])) for k in "ab")
    pairs = a.join(b, "lang").where("a_i <> b_i")
    none = _f(F.col("a_zero"), F.col("b_zero"))
    there, back = ((side, F.col("m") * (f - none)) for side, f in (("a_i", _f(F.col("p"), F.col("b_zero"))), ("b_i", _f(F.col("a_zero"), F.col("p")))))
    one = [single.withColumnRenamed("i", side).join(pairs, ["lang", side]).select("lang", "a_i", "b_i", value.alias("one")) for side, value in (there, back)]
    moved = one[0].unionByName(one[1]).groupBy("lang", "a_i", "b_i").agg(F.sum("one").alias("one"))
    value = F.col("v") * _f(F.col("a_zero"), F.col("b_zero")) + F.coalesce("one", F.lit(0)) + F.coalesce("both", F.lit(0))
    pairs = pairs.join(moved, ["lang", "a_i", "b_i"], "left").join(both.select("lang", F.col("a").alias("a_i"), F.col("b").alias("b_i"), "both"), ["lang", "a_i", "b_i"], "left") \
        .select("lang", F.col("a_source").alias("source"), F.lit("pair").alias("part"), F.col("b_source").alias("item"), F.when(some, value).otherwise(0).cast("long").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return pairs.unionByName(terms)
