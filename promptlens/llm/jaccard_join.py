"""N-gram Jaccard join by parity sketches.

A document's set of word shingles is XOR-hashed into a sketch of m blocks: every shingle
falls into one block and is XORed into it. A differing shingle changes one block at
most, so the number of differing blocks (the sketches' Hamming distance) is a lower
bound on the symmetric difference. Documents link only if that difference is at most d,
which the sizes of a band bound, so linked sketches of a band agree on m - d blocks or more
(pigeonhole). Three exact consequences keep the join small:

* a document that shares fewer than m - d blocks with others at all has no link;
* of its shared blocks it need offer only the rarest, all but m - d - 1 of them;
* documents that share a block are first verified against one pivot of that block; only
  documents still in different components meet each other, under the Hamming bound of a
  second, bit-level parity sketch.

Where more than ``OUTSIDE`` documents of a block stay outside its pivot's component (texts of
one template), they do not meet directly. A second pigeonhole level takes the shingles as
the finest blocks: of a set's rarest shingles one more than a partner of a given size may
miss, so linked sets meet at a rare shingle, by pairs of sizes that leave room for a link.

Every surviving pair is verified on the whole shingle sets. Documents with equal sets are
one vertex from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptlens.llm.batches import IS_SPACE, P, mixed, slices, span_hashes
from promptlens.llm.common import bit_filter, maybe_in, whole_rows, without, written

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
# FIXED VALUES: salts of the hashes.
SALTS = [np.uint64(0x243F6A8885A308D3 * (2 * i + 1) & (1 << 64) - 1) for i in range(8)]
BYTES = 1 << 21
SKETCH_WORDS = 8  # of the bit-level sketch
# Documents of a block outside its pivot's component that meet the others directly; both ways find the same links.
OUTSIDE = 64
# Cells of the shingle counts that order shingles by rarity: 8 MB of them in a task, whatever the data.
RARITY_CELLS = 1 << 20


@dataclass(frozen=True)
class Measure:
    """Documents link at ``den * |A and B| >= num * |A or B|`` over shingles of ``words`` words.

    ``slack``: blocks per block that may differ; ``offer``: how many of them, the heaviest, take
    part. More blocks give stronger counts and more rows; light blocks are the ones that
    unlike texts share. ``growth``: ratio of the sizes of a band.
    """

    words: int = 3
    num: int = 90
    den: int = 100
    slack: float = 1.5
    offer: float = 1.5
    growth: float = 1.5

    def furthest(self, sizes: int) -> int:
        """The largest symmetric difference of linked sets whose sizes add up to ``sizes``."""
        return (self.den - self.num) * sizes // (self.den + self.num)

    def smallest(self) -> int:
        """The smallest set that links with a different one (none does at a similarity of 1)."""
        if self.num >= self.den:
            return 1 << 62
        n = 1
        while n * self.den < self.num * (n + 1):
            n += 1
        return n

    def bands(self, upto: int) -> list[int]:
        """The least size of each band, up to the one that holds ``upto``, and the next; links reach the next band at most."""
        lo = [self.smallest()]
        while lo[-1] <= upto:
            lo.append(max(lo[-1] + 1, int(lo[-1] * self.growth), (lo[-1] - 1) * self.den // self.num + 1))
        return lo

    def blocks(self, below: int) -> tuple[int, int]:
        """(m, blocks that take part) of the band of sizes under ``below``.

        The lightest blocks by number of shingles, then key, stay out: an order of contents,
        in which equal blocks rank alike. So of the m - d blocks or more on which two linked
        sketches agree, at most as many drop out as either leaves out.
        """
        d = self.furthest(2 * (below - 1))
        m = max(d + 1, int(np.ceil(self.slack * (d + 1))))
        return m, min(m, max(d + 1, int(np.ceil(self.offer * (d + 1)))))

    def agreed(self, below: int) -> int:
        """Of the blocks that take part, how many linked sketches share at least."""
        return self.blocks(below)[1] - self.furthest(2 * (below - 1))


# Near copies by the usual measure: five-word shingles, similarity 0.8.
NEAR = Measure(words=5, num=80, slack=1.3, offer=1.1)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every word, computed for slices that end at white space."""
    out, lo = [], 0
    while lo < len(text):
        hi = lo + BYTES
        if hi < len(text):
            while hi < len(text) and not IS_SPACE[text[hi]]:
                hi += 1
        part = np.frombuffer(text[lo:hi], np.uint8)
        lo = hi
        space = IS_SPACE[part]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
        start, end = edge[0::2], edge[1::2]
        out.append(span_hashes(part, start, end))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text, A-Z lower-cased; a shorter text is one shingle."""
    w = word_hashes(text.encode("utf-8", "surrogatepass").translate(LOWER))
    k = min(words, len(w))
    if not k:
        return w
    h = np.full(len(w) - k + 1, SALTS[0] + np.uint64(k), np.uint64)
    for i in range(k):
        h = mixed((h ^ w[i:len(w) - k + 1 + i]) * np.uint64(P))
    return np.unique(h)


def sketch(h: np.ndarray, m: int, salt: int, offer: int | None = None) -> np.ndarray:
    """The m block parities of a shingle set, each made a key by hashing in its place and band; of them the ``offer`` heaviest."""
    block = (((mixed(h ^ SALTS[1]) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(block, kind="stable")
    first = np.flatnonzero(np.diff(block[order], prepend=-1))
    parity = np.zeros(m, np.uint64)
    if len(h):
        parity[block[order][first]] = np.bitwise_xor.reduceat(mixed(h ^ SALTS[2])[order], first)
    keys = mixed(mixed(parity ^ SALTS[3]) + mixed(np.arange(m, dtype=np.uint64) + np.uint64(salt << 32))).view(np.int64)
    if offer is None or offer >= m:
        return keys
    return keys[np.lexsort((keys, -np.bincount(block, minlength=m)))[:offer]]


def bit_sketch(h: np.ndarray) -> np.ndarray:
    """Parity bits of the shingles: SKETCH_WORDS longs whose Hamming distance bounds the symmetric difference from below."""
    bit = mixed(h ^ SALTS[4]) >> np.uint64(64 - 6 - (SKETCH_WORDS.bit_length() - 1))
    odd = np.bincount(bit.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sketches(measure: Measure):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows = measure.bands(1)
        for ids, texts in slices(batches):
            out: list[list] = [[] for _ in range(8)]
            for doc_id, text in zip(ids, texts):
                h = shingles(text, measure.words)
                n = len(h)
                if n >= lows[-1]:
                    lows = measure.bands(n)
                keys: list[np.ndarray | None] = [None, None]
                need = [0, 0]
                if n >= lows[0]:
                    j = int(np.searchsorted(lows, n, "right"))  # the home band is j - 1, of sizes under lows[j]
                    m, offer = measure.blocks(lows[j])
                    keys[0], need[0] = sketch(h, m, j, offer), measure.agreed(lows[j])
                    if n * measure.den >= measure.num * lows[j]:  # it can link with sets of the next band
                        if len(lows) <= j + 1:
                            lows = measure.bands(lows[j])
                        m, offer = measure.blocks(lows[j + 1])
                        keys[1], need[1] = sketch(h, m, j + 1, offer), measure.agreed(lows[j + 1])
                with np.errstate(over="ignore"):
                    digest = [int(np.int64(mixed(h ^ s).sum(dtype=np.uint64).view(np.int64))) for s in SALTS[5:7]]
                for col, v in zip(out, (doc_id, n, *digest, keys[0], need[0], keys[1], need[1])):
                    col.append(v)
            longs = pa.list_(pa.int64())
            types = [pa.int64()] * 4 + [longs, pa.int32(), longs, pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)],
                                             names=["doc_id", "n", "digest1", "digest2", "home", "home_need", "next", "next_need"])
    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            sets = [shingles(t, words) for t in texts]
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()), pa.array([len(h) for h in sets], pa.int64()),
                pa.array([h.tobytes() for h in sets], pa.binary()), pa.array([bit_sketch(h) for h in sets], pa.list_(pa.int64()))],
                names=["doc_id", "n", "shingles", "bits"])
    return run


def _linked(measure: Measure):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(measure.den * both >= measure.num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _cells(h: np.ndarray) -> np.ndarray:
    return (mixed(h ^ SALTS[7]) % np.uint64(RARITY_CELLS)).astype(np.int64)


def _cell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(RARITY_CELLS, np.int64)
    for b in batches:
        for x in b.column(0).to_pylist():
            np.add.at(counts, _cells(np.frombuffer(x, np.uint64)), 1)
    cell = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(counts[cell], pa.int64())], names=["cell", "n"])


def _rarest(measure: Measure, counts):
    """(doc_id, n, c, s, p): of each set the rarest shingles s, by their place p, that a linked set cannot miss altogether."""
    names = ["doc_id", "n", "c", "s", "p"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        for b in batches:
            for i, c, x in zip(*(b.column(k).to_pylist() for k in range(3))):
                h = np.frombuffer(x, np.uint64)
                first = np.lexsort((h, counts.value[_cells(h)]))[:len(h) + 1 - -(-measure.num * len(h) // measure.den)]
                k = len(first)
                parts.append([np.full(k, i), np.full(k, len(h)), np.full(k, c), h[first].view(np.int64), np.arange(1, k + 1)])
                if len(parts) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(col)) for col in zip(*parts)], names=names)
                    parts = []
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(col)) for col in zip(*parts)], names=names)
    return run


def _by_size(sets: DataFrame, members: DataFrame, measure: Measure) -> DataFrame:
    """(key, side, want, doc_id, c): ``members`` (doc_id, c) under the rare shingles and pairs of sizes by which links must meet.

    Linked sets of sizes n and n2 share ``need`` shingles, so the rarest that they share is
    followed in each by need - 1 shingles at least, in any one order of all shingles. The
    order is by counts per cell of shingle hashes. A key is a shingle and two sizes; the
    sets of one size (``side``) meet those of the other (``want``).
    """
    of = written(sets.join(members, "doc_id").select("doc_id", "c", "shingles"), "hot-sets")
    found = of.select("shingles").mapInArrow(_cell_counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(RARITY_CELLS, np.int64)
    counts[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(counts)
    rows = written(of.mapInArrow(_rarest(measure, shared), "doc_id long, n long, c long, s long, p long"), "rare-shingles")
    sizes = rows.groupBy("s", F.col("n").alias("n2")).agg(F.count("*").alias("k"))
    need = f"({measure.num} * (n + n2) + {measure.den + measure.num - 1}) div {measure.den + measure.num}"
    return rows.join(sizes, "s").where(f"n <> n2 or k > 1").where(f"{measure.den} * least(n, n2) >= {measure.num} * greatest(n, n2)") \
        .where(f"{need} <= n - p + 1 and {need} <= n2") \
        .select(F.xxhash64("s", F.least("n", "n2"), F.greatest("n", "n2")).alias("key"), (F.col("n") > F.col("n2")).alias("side"),
                (F.col("n") < F.col("n2")).alias("want"), "doc_id", "c")


def _hot_links(sets: DataFrame, members: DataFrame, links: DataFrame, measure: Measure, verified) -> DataFrame:
    """Links among ``members`` (doc_id, c) that, with ``links``, span the components of all links among them.

    As for blocks, pivots come first, and then documents still in different components. So a
    key's work grows with the product of its documents outside the pivot's component and the
    others only where sets agree up to their last possible shingle and still do not link.
    """
    pair = [F.least("doc_id", "doc2").alias("a"), F.greatest("doc_id", "doc2").alias("b")]
    rows = written(_by_size(sets, members, measure), "rare-blocks")
    pivot = rows.groupBy("key", F.col("side").alias("want")).agg(F.min("doc_id").alias("doc2"))
    first = verified(rows.join(pivot, ["key", "want"]).where("doc_id <> doc2").select(*pair).distinct())
    labels = components(links.unionByName(first))
    placed = written(rows.drop("c").join(labels, F.col("doc_id") == F.col("v"), "left")
                     .select("key", "side", "want", "doc_id", F.coalesce("component", "doc_id").alias("c")), "rare-placed")
    spread = placed.groupBy("key").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi"), F.min_by("c", F.struct("side", "doc_id")).alias("home")) \
        .where("_lo < _hi").select("key", "home")
    at = written(placed.join(spread, "key"), "rare-open")
    other = at.select("key", F.col("side").alias("want"), F.col("doc_id").alias("doc2"), F.col("c").alias("c2"))
    rest = at.where("c <> home").join(other, ["key", "want"]).where("c <> c2").select(*pair).distinct()
    return first.unionByName(verified(rest))


def components(edges: DataFrame) -> DataFrame:
    """(v, component): the least vertex reachable, for every vertex of ``edges`` (a, b).

    Each round takes the least label among the neighbours and then the label of that label;
    rounds are written to shared files, and end when no label changes.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "links")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("component")), "labels")
    while True:
        heard = both.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("component").alias("heard"))
        near = labels.join(heard, F.col("v") == F.col("a")).select("v", "component", F.least("component", "heard").alias("now"))
        far = labels.select(F.col("v").alias("now"), F.col("component").alias("beyond"))
        found = written(near.join(far, "now").select("v", F.least("now", "beyond").alias("component"),
                                                    (F.least("now", "beyond") < F.col("component")).alias("changed")), "labels")
        labels = found.select("v", "component")
        if not found.where("changed").limit(1).count():
            return labels


def _offers(sketches: DataFrame, measure: Measure) -> DataFrame:
    """(doc_id, key, df, heat): the blocks by which documents must meet, after counts have removed the rest."""
    rows = sketches.select("doc_id", F.inline(F.expr(
        "filter(array(struct(0 as b, home_need as need, home as keys), struct(1 as b, next_need as need, next as keys)), x -> x.keys is not null)"))) \
        .select("doc_id", "b", "need", F.explode("keys").alias("key"))
    met = written(rows.groupBy("key").agg(F.count("*").alias("df")).where("df > 1").select("key"), "block-counts")
    rows = maybe_in(rows, "key", bit_filter(met, "key"), "_met").where("_met").drop("_met").join(met, "key")
    # Once: the counts that remain fall by little when the step is repeated.
    rows = written(rows, "blocks")
    enough = rows.groupBy("doc_id", "b").agg(F.count("*").alias("shared"), F.max("need").alias("_need")).where("shared >= _need").select("doc_id", "b")
    rows = rows.join(enough, ["doc_id", "b"])
    df = written(rows.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"), "block-df")
    rows = rows.join(df, "key")
    rows = written(rows, "blocks")
    own = Window.partitionBy("doc_id", "b")
    rank = F.row_number().over(own.orderBy("df", "key"))
    return rows.select("doc_id", "key", "df", F.count("*").over(own).alias("shared"), "need", rank.alias("rank"), F.sum("df").over(own).alias("heat")) \
        .where("rank <= shared - need + 1").select("doc_id", "key", "df", "heat")


def similar_pairs(docs: DataFrame, sketches: DataFrame, measure: Measure) -> DataFrame:
    """Links (a, b) between documents of ``sketches`` that span the same components as all links."""
    ratio = f"{measure.den} * least(n, n2) >= {measure.num} * greatest(n, n2)"
    furthest = f"{measure.den - measure.num} * (n + n2) div {measure.den + measure.num}"
    hamming = "aggregate(zip_with(bits, bits2, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    offers = _offers(sketches, measure)
    wanted = written(offers, "offers")
    ids = wanted.select("doc_id").distinct()
    texts = maybe_in(docs, "doc_id", bit_filter(ids, "doc_id"), "_wanted").where("_wanted").select("doc_id", "text")
    sets = written(texts.mapInArrow(_sets(measure.words), "doc_id long, n long, shingles binary, bits array<long>").join(ids, "doc_id"), "shingle-sets")
    offers = written(wanted.join(sets.select("doc_id", "n", "bits").dropDuplicates(["doc_id"]), "doc_id"), "offers-bits")

    def verified(pairs: DataFrame) -> DataFrame:
        a, b = (sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"s_{x}")) for x in "ab")
        return written(pairs.join(a, "a").join(b, "b").select("a", "b", "s_a", "s_b").mapInArrow(_linked(measure), "a long, b long"), "verified")

    pivot = offers.groupBy("key").agg(F.max(F.struct("heat", (-F.col("doc_id")).alias("id"), "n", "bits")).alias("p")) \
        .select("key", (-F.col("p.id")).alias("pivot"), F.col("p.n").alias("n2"), F.col("p.bits").alias("bits2"))
    first = offers.join(pivot, "key").where("doc_id <> pivot").where(ratio).where(f"{hamming} <= {furthest}") \
        .select(F.least("doc_id", "pivot").alias("a"), F.greatest("doc_id", "pivot").alias("b")).distinct()
    links = verified(first)
    labels = components(links)
    # Keys whose documents are all in one component are done; elsewhere those outside the pivot's component meet the rest.
    placed = offers.join(labels, F.col("doc_id") == F.col("v"), "left").withColumn("c", F.coalesce("component", "doc_id")) \
        .select("key", "doc_id", "n", "bits", "c")
    placed = written(placed, "placed")
    open_keys = placed.groupBy("key").agg(F.min("c").alias("_lo"), F.max("c").alias("_hi")).where("_lo < _hi").select("key")
    at = placed.join(open_keys, "key").join(pivot.select("key", "pivot"), "key")
    home = at.where("doc_id = pivot").select("key", F.col("c").alias("home"))
    at = written(at.drop("pivot").join(home, "key"), "open-blocks")
    hot = written(at.where("c <> home").groupBy("key").agg(F.count("*").alias("_outside")).where(F.col("_outside") > OUTSIDE).select("key"), "hot-blocks")
    if not hot.isEmpty():
        members = written(at.join(hot, "key").select("doc_id", "c").distinct(), "hot-documents")
        links = written(links.unionByName(_hot_links(sets, members, links, measure, verified)), "links")
        at = at.join(hot, "key", "left_anti")
    other = at.select("key", F.col("doc_id").alias("doc2"), F.col("n").alias("n2"), F.col("bits").alias("bits2"), F.col("c").alias("c2"))
    rest = at.where("c <> home").join(other, "key").where("c <> c2 and (c2 = home or doc_id < doc2)").where(ratio).where(f"{hamming} <= {furthest}") \
        .select(F.least("doc_id", "doc2").alias("a"), F.greatest("doc_id", "doc2").alias("b")).distinct()
    return links.unionByName(verified(rest))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", measure: Measure = Measure()) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (least doc_id reachable by links).

    Sets are shingles of 64-bit hashes. A document without words has an empty set and is its
    own component; one with fewer words than a shingle is one shingle. Rows with the same
    doc_id are one vertex. Null ids keep a null component and link with nothing; an empty
    table gives no rows; other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = ("doc_id long, n long, digest1 long, digest2 long, home array<long>, home_need int, next array<long>, next_need int")
    sketches = written(docs.mapInArrow(_sketches(measure), schema), "sketches")
    key = ["n", "digest1", "digest2"]
    named = sketches.where("n > 0 and doc_id is not null")
    first = written(named.groupBy(*key).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "equal-sets")
    # Of equal sets only the first document goes on; the others are found through the classes with two ids.
    vid = F.xxhash64("doc_id", *key).alias("vid")
    copies = named.select("doc_id", *key).join(first.where("first < last"), key).where("doc_id > first").select(vid)
    alone = without(named.select("doc_id", "n", "home", "home_need", "next", "next_need", vid), copies, "vid")
    links = similar_pairs(docs, alone, measure)
    labels = components(links.unionByName(_same_id(sketches, first, key)))
    classes = first.join(labels, F.col("first") == F.col("v"), "left").select(*key, F.coalesce("component", "first").alias("component_id"))
    out = sketches.select("doc_id", *key).join(classes, key, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _same_id(sketches: DataFrame, first: DataFrame, key: list[str]) -> DataFrame:
    """Links between the classes of rows that share a doc_id but not a text (none where ids are unique)."""
    twice = sketches.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.count_distinct(*key).alias("k")).where("k > 1").select("doc_id")
    of = sketches.select("doc_id", *key).join(twice, "doc_id").join(first.drop("last"), key).select("doc_id", "first").distinct()
    return of.join(of.groupBy("doc_id").agg(F.min("first").alias("b")), "doc_id").where("first <> b").select(F.col("first").alias("a"), "b")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", measure: Measure = NEAR) -> DataFrame:
    """``docs`` with one row, that with the smallest doc_id, of each component; documents without words stay; all columns.

    A doc_id with several texts, or none, does not tie them together: each (doc_id, text) is a
    document of its own, linked and dropped by a number. Rows that repeat both are one document.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("_id"))
    twice = written(ids.where("_id is not null").groupBy("_id").agg(F.count("*").alias("n")).where("n > 1").select("_id"), "repeated-ids")
    top = ids.agg(F.max("_id")).first()[0] or 0
    rows = maybe_in(whole_rows(docs, _doc_id=id_col, _text=text_col).withColumn("_id", F.col("_doc_id").cast("long")), "_id", bit_filter(twice, "_id"), "_twice")
    rows = rows.withColumn("_twice", F.col("_twice") | F.col("_id").isNull())
    # Only rows whose id is none or may be repeated move; in the usual case there are none.
    digest = F.sha2(F.concat_ws(":", F.col("_id").isNull().cast("string"), F.col("_id").cast("string"), F.coalesce("_text", F.lit(""))), 256)
    marked = rows.where("_twice").withColumn("_key", digest)
    numbers = written(marked.select("_key", "_id").distinct(), "repeated-rows")
    numbers = written(numbers.select("_key", "_id", (F.monotonically_increasing_id() + F.lit(top) + 1).alias("_row")), "row-numbers")
    again = written(marked.dropDuplicates(["_key"]).join(numbers.select("_key", "_row"), "_key").select("_doc", "_text", "_row"), "numbered-rows")
    rows = rows.where("not _twice").select("_doc", "_text", F.col("_id").alias("_row")).unionByName(again)
    classes = written(jaccard_classes(rows.select("_row", "_text"), "_row", "_text", measure).where("n_shingles > 0").select(F.col("doc_id").alias("_row"), "component_id"), "classes")
    # Numbers say nothing about order: where a component has some, its smallest doc_id is looked up.
    order = lambda i, row: F.struct(F.col(i).isNull().alias("none"), F.col(i).alias("id"), F.col(row).alias("row"))
    least = classes.join(numbers, "_row").groupBy("component_id").agg(F.min(order("_id", "_row")).alias("least")) \
        .select("component_id", F.when(F.col("component_id") > top, F.col("least")).otherwise(F.least("least", order("component_id", "component_id")))["row"].alias("first"))
    gone = classes.join(least, "component_id", "left").where("_row <> coalesce(first, component_id)").select("_row")
    return without(rows, gone, "_row").select("_doc.*")
