"""Finding rule patterns in texts by their bytes: numpy passes that run inside Spark tasks.

UTF-8 strings contain one another exactly where their bytes do, so both passes work on bytes.
Grams of k bytes are held whole in one number; a text's are made a block at a time, so that the
arrays of a pass are bounded whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# No UTF-8 string holds this byte: grams that reach beyond a block's end equal none of a pattern.
PAD = np.full(8, 0xFF, np.uint8)
# Grams found in a block are compared with their patterns so many pairs at a time.
PAIRS = 1 << 18
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # FIXED VALUE: an odd number


def grams(part: np.ndarray, kinds: list[int]) -> dict[int, np.ndarray]:
    """For each k of ``kinds`` (1, 2, 3, 4, 8) the gram of k bytes at each place of ``part``; those cut by its end equal no pattern's."""
    b = np.concatenate((part, PAD)).astype(np.uint64)
    n = len(part)
    out = {1: b[:n]}
    if max(kinds) > 1:
        two = b[:-1] | b[1:] << np.uint64(8)
        out[2], out[3] = two[:n], two[:n] | b[2:n + 2] << np.uint64(16)
        if max(kinds) > 3:
            four = two[:-2] | two[2:] << np.uint64(16)
            out[4] = four[:n]
            if max(kinds) > 4:
                out[8] = four[:n] | four[4:n + 4] << np.uint64(32)
    return {k: out[k] for k in kinds}


def spread(x: np.ndarray, bits: int) -> np.ndarray:
    """The upper ``bits`` bits of a product: places in a table."""
    return (x * _MULTIPLIER) >> np.uint64(64 - bits)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls; nothing is copied."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


class FirstRule:
    """The first of a bounded list of patterns that each text contains.

    The list is taken in parts, each several times as long as all before it, and a text that holds a
    pattern of one part is not searched for the next: how often a text holds later ones costs nothing.
    """

    FIRST_PART, GROWTH = 256, 16

    def __init__(self, patterns: list[str]):
        self.parts = []
        lo, hi = 0, self.FIRST_PART
        while lo < len(patterns):
            self.parts.append((lo, PatternIndex(patterns[lo:hi])))
            lo, hi = hi, hi * self.GROWTH

    def first(self, raw: np.ndarray, offsets: np.ndarray, block: int) -> np.ndarray:
        """The number of the first pattern in each text, -1 where there is none."""
        out = np.full(len(offsets) - 1, -1, np.int64)
        left = np.arange(len(out))
        for lo, index in self.parts:
            got = index.first(raw, offsets, block)
            out[left] = np.where(got >= 0, got + lo, -1)
            missed = np.flatnonzero(got < 0)
            if not len(missed):
                break
            if len(missed) < len(left):
                raw = np.concatenate([raw[a:b] for a, b in zip(offsets[missed].tolist(), offsets[missed + 1].tolist())])
                offsets = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.diff(offsets)[missed])))
                left = left[missed]
        return out


class PatternIndex:
    """Patterns by their rarest grams.

    A pattern of 8 bytes or more is looked for by one of its grams of 8 bytes, one of 4 to 7 by a
    gram of 4, a shorter one by itself: by that gram which the fewest patterns of the list hold. A
    bit table drops almost all places of a text, a search among the sorted grams the rest but for
    true ones, and there the pattern is compared byte by byte.
    """

    TABLE_BITS = 20

    def __init__(self, patterns: list[str]):
        raws = [p.encode("utf-8", "surrogatepass") for p in patterns]
        self.size = np.asarray([len(r) for r in raws], np.int64)
        width = -(-self.size // 8) * 8
        self.word = (np.cumsum(width) - width) // 8
        self.words = np.frombuffer(b"".join(r.ljust(w, b"\0") for r, w in zip(raws, width.tolist())), "<u8")
        kind = np.select([self.size >= 8, self.size >= 4], [8, 4], self.size)
        self.at = np.zeros(len(raws), np.int64)
        self.kinds: dict[int, tuple] = {}
        for k in sorted(set(kind.tolist())):
            rules = np.flatnonzero(kind == k)
            flat = np.frombuffer(b"".join(raws[r] for r in rules.tolist()), np.uint8)
            size = self.size[rules]
            of = np.repeat(np.arange(len(rules)), size)
            place = np.arange(len(flat)) - (np.cumsum(size) - size)[of]
            gram = grams(flat, [k])[k]
            whole = place + k <= size[of]
            of, place, gram = of[whole], place[whole], gram[whole]
            by = np.lexsort((of, gram))
            new = np.ones(len(by), bool)
            new[1:] = (gram[by][1:] != gram[by][:-1]) | (of[by][1:] != of[by][:-1])
            shared, number = np.unique(gram[by][new], return_counts=True)
            held = number[np.searchsorted(shared, gram)]
            order = np.lexsort((place, held, of))
            best = order[np.searchsorted(of[order], np.arange(len(rules)))]
            self.at[rules] = place[best]
            by = np.lexsort((rules, gram[best]))
            values, first, count = np.unique(gram[best][by], return_index=True, return_counts=True)
            table = np.zeros(1 << self.TABLE_BITS, bool)
            table[spread(values, self.TABLE_BITS)] = True
            self.kinds[k] = (table, values, first, count, rules[by])

    def first(self, raw: np.ndarray, offsets: np.ndarray, block: int) -> np.ndarray:
        """The number of the first pattern in each text, -1 where there is none."""
        none = len(self.size)
        best = np.full(len(offsets) - 1, none, np.int64)
        kinds = list(self.kinds)
        for lo in range(0, len(raw), block):
            part = grams(raw[lo:lo + block + 7], kinds)
            for k, (table, values, first, count, rules) in self.kinds.items():
                g = part[k][:block]
                place = np.flatnonzero(table[spread(g, self.TABLE_BITS)])
                slot = np.minimum(np.searchsorted(values, g[place]), len(values) - 1)
                true = values[slot] == g[place]
                place, slot = place[true] + lo, slot[true]
                pairs = np.cumsum(count[slot])
                a = 0
                while a < len(place):
                    b = max(a + 1, int(np.searchsorted(pairs, (pairs[a - 1] if a else 0) + PAIRS, "right")))
                    self._compare(raw, offsets, place[a:b], slot[a:b], first, count, rules, best)
                    a = b
        return np.where(best < none, best, -1)

    def _compare(self, raw, offsets, place, slot, first, count, rules, best) -> None:
        n = count[slot]
        of = np.repeat(np.arange(len(place)), n)
        rule = rules[np.arange(len(of)) - (np.cumsum(n) - n)[of] + first[slot][of]]
        start = place[of] - self.at[rule]
        text = np.searchsorted(offsets, place, "right")[of] - 1
        open_ = (rule < best[text]) & (start >= offsets[text]) & (start + self.size[rule] <= offsets[text + 1])
        rule, start, text = rule[open_], start[open_], text[open_]
        done = np.zeros(len(rule), np.int64)
        while len(rule):
            left = self.size[rule] - done
            bytes_ = raw[np.minimum((start + done)[:, None] + np.arange(8), len(raw) - 1)]
            got = np.where(np.arange(8) < left[:, None], bytes_, np.uint8(0)).view("<u8")[:, 0]
            same = got == self.words[self.word[rule] + done // 8]
            ended = same & (left <= 8)
            np.minimum.at(best, text[ended], rule[ended])
            on = same & (left > 8)
            rule, start, text, done = rule[on], start[on], text[on], done[on] + 8


# Anchors of any number of rules: a pattern of LONG_RULE bytes or more is anchored on a minimizer, the least
# hash of WINDOW grams of 8 bytes in a row; one of 4 bytes or more on a gram of 4, a shorter one on itself.
WINDOW = 8
LONG_RULE = 8 + WINDOW - 1


def _hashed(k: int, gram: np.ndarray) -> np.ndarray:
    x = gram * _MULTIPLIER + np.uint64(k)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def kind_of(size: np.ndarray) -> np.ndarray:
    return np.select([size >= LONG_RULE, size >= 4], [8, 4], size)


def anchors(raw: np.ndarray, offsets: np.ndarray, kinds: list[int], block: int,
            bits: np.ndarray | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, texts, anchors) of each block of bytes, distinct in it; those not in the bit filter are left out."""
    for lo in range(0, len(raw), block):
        part = raw[lo:lo + block + LONG_RULE - 1]
        for k, g in grams(part, kinds).items():
            h = _hashed(k, g)
            if k == 8:
                reach = LONG_RULE
                for step in (1, 2, 4):
                    h = np.minimum(h[:-step], h[step:])
            else:
                reach = k
            h = h[:min(block, len(part) - reach + 1)] if len(part) >= reach else h[:0]
            place = np.arange(lo, lo + len(h))
            text = np.searchsorted(offsets, place, "right") - 1
            keep = place + reach <= offsets[text + 1] if len(place) else np.empty(0, bool)
            if bits is not None:
                word, bit = bit_of(h)
                keep &= (bits[word] >> bit & np.uint64(1)).astype(bool)
            h, text = h[keep], text[keep]
            order = np.lexsort((text, h))
            h, text = h[order], text[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
            yield k, text[new], h[new].view(np.int64)


# The filter of all rules' anchors that texts are held against: 2^20 words of 64 bits, whatever the number of rules.
FILTER_BITS = 20


def bit_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return spread(h, FILTER_BITS).astype(np.int64), h & np.uint64(63)
