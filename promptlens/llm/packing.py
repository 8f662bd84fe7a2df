"""Best-fit packing with certified bin counts.

Documents become token pieces in one pass over the texts; from then on only narrow rows
move. Pieces are dealt by hash into groups of a bounded number of tokens, and each group
is packed by best-fit decreasing. Dual-feasible functions give a lower bound on the bins
of its pieces; where the bound meets the bin count the packing is certified as optimal.
Groups with a gap give up their bins that are not full: those documents are exchanged
between the groups and packed anew, and the result stays if it needs fewer bins.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptlens.llm.batches import span_hashes
from promptlens.llm.common import written

MAX_TOKENS = 2048
# Documents are followed by this id.
END_ID = 0
# Tokens of a group: 8192 full bins.
GROUP_TOKENS = 1 << 24
ROUNDS = 3
# Units whose ids a Python worker remembers; a full memory is cleared before the next batch.
REMEMBERED = 250_000
# Texts are encoded together up to this many bytes: a worker's arrays are about 100 times as large.
BATCH_BYTES = PART_CHARS = 1 << 18
# Bytes that no plain word has (tails of two-byte letters are looked at apart): controls, apostrophe, other lead bytes.
ODD_BYTE = np.zeros(256, bool)
ODD_BYTE[[*range(10), *range(11, 32), 39, 127, *range(0xC0, 0xC3), *range(0xC4, 256)]] = True
# Kinds of bytes: 0 white space, 1 letter, 2 digit, 3 sign.
KIND = np.full(256, 3, np.uint8)
KIND[[32, 10]], KIND[[*range(97, 123), 0xC3]], KIND[48:58] = 0, 1, 2
END_OF_WORD = "</w>"

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACE = PIECE + ", seq_group long, bin int, offset long, fill long, gap int"


class WordIds:
    """Token ids of texts, as little-endian 32-bit numbers, from units that are encoded once.

    The tokenizer drops white space and never joins characters across it. A word of plain
    characters (printable ASCII but the apostrophe, Latin-1 letters) falls into runs of letters,
    single digits and runs of signs, which are the tokenizer's pre-tokens: each run is a unit, and
    its ids come from the tokenizer's merges alone, many runs in one call (the last token of a
    pre-token has the end-of-word mark). Any other word is a unit for the whole tokenizer.
    Units are found and hashed in numpy; only new ones reach the tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.last[i] = token.endswith(END_OF_WORD)
        self._forget()

    def _forget(self) -> None:
        self.slots: dict[int, int] = {}
        self.start, self.size, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, "<u4")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Texts beyond PART_CHARS are encoded in parts that end at a space or line end."""
        parts = [_parts(t) for t in texts]
        flat = iter(self._encode([x for ps in parts for x in ps]) if len(texts) > 1 else [i for x in parts[0] for i in self._encode([x])] if texts else [])
        return [np.concatenate([next(flat) for _ in ps]) if len(ps) > 1 else next(flat) for ps in parts]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.slots) > REMEMBERED:
            self._forget()
        raws = [t.encode("utf-8", "surrogatepass") for t in texts]
        raw = b" ".join(raws) + b" "
        text = np.frombuffer(raw, np.uint8)
        low, start, end, odd = _units(text)
        h = span_hashes(low, start, end) ^ odd.astype(np.uint64)
        found, first, at = np.unique(h, return_index=True, return_inverse=True)
        get = self.slots.get
        slot = np.fromiter((get(x, -1) for x in found.tolist()), np.int64, len(found))
        new = np.flatnonzero(slot < 0)
        if len(new):
            slot[new] = self._learn(found[new], [low[s:e].tobytes() for s, e in zip(start[first[new]].tolist(), end[first[new]].tolist())], odd[first[new]])
        of = slot[at]
        size = self.size[of]
        stop = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
        ids = self.ids[np.repeat(self.start[of] - stop[:-1], size) + np.arange(stop[-1])]
        cuts = stop[np.searchsorted(start, np.cumsum([0] + [len(r) + 1 for r in raws]))].tolist()
        return [ids[lo:hi] for lo, hi in zip(cuts, cuts[1:])]

    def _learn(self, hashes: np.ndarray, units: list[bytes], odd: np.ndarray) -> np.ndarray:
        """Encode new units; their slots."""
        names = [u.decode("utf-8", "replace") for u in units]
        sizes = np.zeros(len(units), np.int64)
        plain, other = np.flatnonzero(~odd), np.flatnonzero(odd)
        got = [np.empty(0, "<u4")]
        if len(plain):
            ids = np.asarray(self.merges.encode_batch_fast([" ".join([names[i] for i in plain.tolist()])], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            assert len(ends) == len(plain)
            sizes[plain] = np.diff(ends, prepend=0)
            got.append(ids)
        if len(other):
            each = [e.ids for e in self.tokenizer.encode_batch_fast([names[i] for i in other.tolist()], add_special_tokens=False)]
            sizes[other] = [len(x) for x in each]
            got += [np.asarray(x, "<u4") for x in each]
        order = np.concatenate((plain, other))
        offsets = np.empty(len(units), np.int64)
        offsets[order] = len(self.ids) + np.cumsum(sizes[order]) - sizes[order]
        slots = np.arange(len(self.size), len(self.size) + len(units))
        self.ids = np.concatenate((self.ids, *got))
        self.start, self.size = np.concatenate((self.start, offsets)), np.concatenate((self.size, sizes))
        self.slots.update(zip(hashes.tolist(), slots.tolist()))
        return slots


def _parts(text: str) -> list[str]:
    out = []
    while len(text) > PART_CHARS:
        cut = max(text.rfind(" ", 0, PART_CHARS), text.rfind("\n", 0, PART_CHARS))
        if cut < 0:
            cut = min((x for x in (text.find(" "), text.find("\n")) if x >= 0), default=len(text))
        out.append(text[:cut])
        text = text[cut + 1:]
    return out + [text]


def _units(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, plain ones in lower case; start, end and oddness of every unit) of UTF-8 bytes."""
    before = np.concatenate((np.full(1, 32, np.uint8), text[:-1]))
    space = (text == 32) | (text == 10)
    tail = (text >= 0x80) & (text < 0xC0)
    after_c3 = before == 0xC3
    bad = ODD_BYTE[text] | (tail & ~after_c3) | (after_c3 & ((text == 0x97) | (text == 0xB7))) | ((text == 124) & (before == 60))
    was_space = np.concatenate((np.ones(1, bool), space[:-1]))
    begins = ~space & was_space
    low = text + np.where((text >= 65) & (text <= 90) | after_c3 & (text <= 0x9E) & tail, 32, 0).astype(np.uint8)
    kind = np.where(tail, 1, KIND[low])
    cut = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    inner = np.concatenate((np.zeros(1, bool), cut)) & ~space
    if bad.any():
        word = np.cumsum(begins)  # number of the word, from 1
        odd_word = np.zeros(int(word[-1]) + 1, bool)
        odd_word[word[bad & ~space]] = True
        inside = odd_word[word] & ~space
        low = np.where(inside, text, low)
        inner &= ~inside
    else:
        inside = np.zeros(len(text), bool)
    starts = begins | inner
    ends = ~space & np.concatenate((space[1:] | starts[1:], np.ones(1, bool)))
    start = np.flatnonzero(starts)
    return low, start, np.flatnonzero(ends) + 1, inside[start]


_WORKER: dict[str, WordIds] = {}


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _batches(rows: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of up to BATCH_BYTES and one more text; only these leave the Arrow batch."""
    lo = n = 0
    for i, size in enumerate(pc.binary_length(rows.column(1)).fill_null(0).to_numpy().tolist() + [BATCH_BYTES]):
        n += size
        if n >= BATCH_BYTES or i >= rows.num_rows:
            part = rows.slice(lo, i + 1 - lo)
            if part.num_rows:
                yield part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
            lo, n = i + 1, 0


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
                 max_tokens: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``max_tokens`` ids of every document (``with_ids``: and their bytes).

    A null text is empty and gives one piece with the end id alone; repeated rows are
    documents of their own; an empty table gives no pieces.
    """
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _WORKER:
            _WORKER[path] = WordIds(path)
        ids = _WORKER[path]
        end = np.asarray([END_ID], "<u4").tobytes()
        for b in batches:
            for keys, texts in _batches(b):
                out: list[list] = [[], [], [], [], [], []]
                for key, tokens in zip(keys, ids.encode(texts)):
                    raw = tokens.tobytes() + end
                    for k, at in enumerate(range(0, len(raw), 4 * max_tokens)):
                        part = raw[at:at + 4 * max_tokens]
                        for col, v in zip(out, (key, k, at // 4, len(part) // 4, zlib.crc32(part), part)):
                            col.append(v)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
                n = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:n], types)], names=list(names[:n]))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")) \
        .mapInArrow(run, PIECE + (", ids binary" if with_ids else ""))


def best_fit(lengths: np.ndarray, capacity: int = MAX_TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, fill of the bin) of each length, packed by best-fit decreasing."""
    order = np.argsort(-lengths, kind="stable")
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what is left in them
    some = 0  # bit r: a bin has r left
    bins, offsets, fills = np.empty(len(lengths), np.int32), np.empty(len(lengths), np.int64), []
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        fit = some >> size
        if fit:
            left = size + (fit & -fit).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                some &= ~(1 << left)
        else:
            left, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        rest = left - size
        if rest:
            free[rest].append(b)
            some |= 1 << rest
    return bins, offsets, np.asarray(fills, np.int64)[bins] if len(lengths) else np.empty(0, np.int64)


def bin_bound(lengths: np.ndarray, capacity: int = MAX_TOKENS) -> int:
    """A number of bins that no packing can undercut: the best of two families of dual-feasible functions.

    f_a keeps lengths in [a, C - a], rounds larger ones up to C and smaller ones to 0;
    u_k rounds l / C to k-ths downwards unless (k + 1) * l / C is whole.
    """
    n = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    count, tokens = np.cumsum(n), np.cumsum(n * size)
    a = np.arange(0, capacity // 2 + 1)
    large = count[capacity] - count[capacity - a]
    middle = tokens[capacity - a] - np.where(a > 0, tokens[a - 1], 0)
    best = int((large + -(-middle // capacity)).max()) if len(lengths) else 0
    for k in range(1, 33):
        whole = (size * (k + 1)) % capacity == 0
        # In units of 1 / (k * C): exact integers.
        value = np.where(whole, size * k, (size * (k + 1) // capacity) * capacity)
        best = max(best, int(-(-int((n * value).sum()) // (k * capacity))))
    return best


def _pack(items: DataFrame, groups: int, salt: int, max_tokens: int) -> DataFrame:
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["doc_id", "piece", "start"], kind="stable", ignore_index=True)
        lengths = g["length"].to_numpy(np.int64)
        b, at, fill = best_fit(lengths, max_tokens)
        g["bin"], g["offset"], g["fill"] = b, at, fill
        g["gap"] = np.int32(int(b.max()) + 1 - bin_bound(lengths, max_tokens))
        return g

    dealt = F.pmod(F.xxhash64("doc_id", "piece", "row", F.lit(salt)), F.lit(max(1, groups)))
    return items.withColumn("seq_group", dealt).groupBy("seq_group").applyInPandas(run, PLACE + ", row long")


def _bins_tokens(df: DataFrame) -> tuple[int, int]:
    r = df.agg(F.sum(F.when(F.col("offset") == 0, 1)), F.sum("length")).first()
    return r[0] or 0, r[1] or 0


def place(pieces: DataFrame, max_tokens: int = MAX_TOKENS, group_tokens: int = GROUP_TOKENS, rounds: int = ROUNDS) -> DataFrame:
    """Add sequence_id and offset to a written table of pieces (columns of PIECE)."""
    items = written(pieces.withColumn("row", F.monotonically_increasing_id()), "pack-pieces")
    whole = items.where(F.col("length") == max_tokens)
    open_items = items.where(F.col("length") < max_tokens)
    tokens = open_items.agg(F.sum("length")).first()[0] or 0
    done = [whole.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("row") * (rounds + 2)).alias("sequence_id"),
                         F.lit(0).cast("long").alias("offset"))]
    number = lambda k: ((F.shiftleft("seq_group", 24) + F.col("bin")) * (rounds + 2) + k + 1)
    keep = lambda df, k: df.select("doc_id", "piece", "start", "length", "ids_crc32", number(k).alias("sequence_id"), "offset")
    now = written(_pack(open_items, -(-tokens // group_tokens), 0, max_tokens), "pack-0")
    for k in range(rounds):
        spare = (F.col("gap") > 0) & (F.col("fill") < max_tokens)
        pool = now.where(spare)
        bins, tokens = _bins_tokens(pool)
        if bins < 2:
            break
        anew = written(_pack(pool.select("doc_id", "piece", "start", "length", "ids_crc32", "row"), -(-tokens // group_tokens), k + 1, max_tokens), f"pack-{k + 1}")
        if _bins_tokens(anew)[0] >= bins:
            break
        done.append(keep(now.where(~spare), k))
        now = anew
    else:
        k = rounds
    done.append(keep(now, k))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
         max_tokens: int = MAX_TOKENS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(token_pieces(docs, id_col, text_col, tokenizer, max_tokens), max_tokens, group_tokens)


def packed_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
               max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(sequence_id, ids): the training sequences themselves, at most ``max_tokens`` ids each, as 32-bit bytes.

    Needs ids that are unique among the documents.
    """
    pieces = token_pieces(docs, id_col, text_col, tokenizer, max_tokens, with_ids=True)
    at = place(token_pieces(docs, id_col, text_col, tokenizer, max_tokens), max_tokens)
    parts = at.join(pieces.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    return parts.groupBy("sequence_id").agg(F.expr(
        "aggregate(sort_array(collect_list(struct(offset, ids))), cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"))
