"""Exact per-key sliding-window admission (the gateway's rate limiter).

Semantics per key, in arrival order (ts, then id): forget remembered hits with
``now - t >= window``; if ``limit`` or more remain, deny and do NOT remember
the hit; otherwise admit and remember it. Denied hits never count, so this is
not a rolling count and has no closed form in SQL window functions: it is an
ordered recurrence per key.

Plan (one key with a third of all rows is spread over its segments):

1. Only (key, ts, id) enter the limiter; the decisions are joined back by these,
   so payload columns never cross into Python.
2. Split points from counts. Time is cut into cells, CELLS of them a little
   longer than the window, and hits are counted per (key, cell) with a map-side
   aggregate: one small row per cell that has hits, whatever the volume. A
   cell c starts an independent segment when
     - all that is remembered has expired: the key's previous cell with hits is
       more than CELLS back, or
     - no cell from c to c + CELLS together with the CELLS before it holds more than
       ``limit`` hits: every hit of the window after the start then sees fewer than
       ``limit`` others, denied ones counted, and is admitted whatever the history;
       after that window everything before c has expired and both runs hold
       the same state.
   Frames are over counts, at most CELLS + 1 rows each, so a flood inside one
   window costs no more than its aggregate.
3. Segment id = the last such cell at or before a row's own, by a running
   maximum over the cells of a key, joined back by (key, cell).
4. ``repartition(key, segment)`` + ``sortWithinPartitions`` + ``mapInPandas``
   walk each segment with a deque of at most ``limit`` timestamps, carried
   across Arrow batches. A run of denied hits is skipped with one binary
   search (the state cannot change until the oldest hit expires), so the
   Python work is O(admitted hits), at most ``limit`` per window per key,
   whatever the request volume. A key that stays over its limit for a long
   stretch is one ordered stream for that stretch: the recurrence itself is
   sequential there; the stream is sorted by the shuffle (spillable) and held
   in O(limit) memory.

Merging two segments of a key into one stream keeps every decision (a split
point is valid for any earlier state), so segment ids need not be unique.
"""

from __future__ import annotations

import re
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptlens.schemas import DEFAULT_RATE_LIMIT, DEFAULT_RATE_WINDOW_S

# Stands for a missing client address: all such requests share one bucket,
# as the gateway files them under one "unknown" client.
NULL_KEY = "\u0000"

# Cells per window: finer cells find more split points.
CELLS = 8
# Parts of a group of requests with one id, time and key, where only some of them are admitted.
SALTS = 64


def _widen(window: float) -> float:
    """A width that surely covers ``now - t < window`` despite float rounding."""
    return window * (1.0 + 1e-9) + 1e-3


def _first_expired(ts: np.ndarray, lo: int, hi: int, oldest: float, window: float) -> int:
    """First index j in [lo, hi) with ts[j] - oldest >= window (ts sorted), else hi."""
    j = lo + int(np.searchsorted(ts[lo:hi], oldest + window, side="left"))
    # searchsorted used oldest + window; settle on the exact predicate.
    while j > lo and ts[j - 1] - oldest >= window:
        j -= 1
    while j < hi and ts[j] - oldest < window:
        j += 1
    return j


def admit_run(ts: np.ndarray, lo: int, hi: int, hits: deque, limit: int, window: float,
              out: np.ndarray) -> None:
    """Decide hits ts[lo:hi] (one key, sorted) into ``out``; ``hits`` is the carried state.

    Python work is O(admitted): a run of denials is skipped with one binary search.
    """
    i = lo
    while i < hi:
        now = ts[i]
        while hits and now - hits[0] >= window:
            hits.popleft()
        if len(hits) < limit:
            hits.append(float(now))
            out[i] = True
            i += 1
        else:
            # Full: every hit before the oldest one expires is denied.
            i = _first_expired(ts, i + 1, hi, hits[0], window)


def _limiter(limit: int, window: float):
    def run(batches):
        cur = None
        hits: deque = deque()
        for pdf in batches:
            n = len(pdf)
            keys = pdf["__k"].to_numpy(dtype=object)
            segs = pdf["__seg"].to_numpy(dtype=np.float64)
            ts = pdf["__ts"].to_numpy(dtype=np.float64)
            out = np.zeros(n, dtype=bool)
            # Segment runs inside this batch: [starts[r], starts[r+1]).
            change = np.ones(n, dtype=bool)
            if n > 1:
                change[1:] = (keys[1:] != keys[:-1]) | (segs[1:] != segs[:-1])
            starts = np.flatnonzero(change).tolist() + [n]
            for r in range(len(starts) - 1):
                lo, hi = starts[r], starts[r + 1]
                if (keys[lo], segs[lo]) != cur:
                    cur = (keys[lo], segs[lo])
                    hits.clear()
                admit_run(ts, lo, hi, hits, limit, window, out)
            yield pd.DataFrame({"__id": pdf["__id"], "admitted": out, "__ts": pdf["__ts"], "__k": pdf["__k"]})
    return run


def _segments(keyed: DataFrame, limit: int, window: float) -> DataFrame:
    """(__k, __ts, __id, __seg) for every row; see the module docstring, steps 2-3."""
    # A null time has no cell of its own: such rows are one segment of their key, far from all others.
    cell = F.floor(F.col("__ts") / F.lit(_widen(float(window)) / CELLS)).cast("long")
    placed = keyed.withColumn("__cell", F.coalesce(cell, F.lit(-(1 << 60))))
    cells = placed.groupBy("__k", "__cell").agg(F.count(F.lit(1)).alias("__n"))
    of_key = Window.partitionBy("__k").orderBy("__cell")
    before = F.lag("__cell").over(of_key)
    held = cells.withColumn("__held", F.sum("__n").over(of_key.rangeBetween(-CELLS, 0))) \
        .withColumn("__gap", before.isNull() | (before < F.col("__cell") - CELLS))
    calm = F.max("__held").over(of_key.rangeBetween(0, CELLS)) <= F.lit(limit)
    starts = held.withColumn("__start", F.when(F.col("__gap") | calm, F.col("__cell")))
    segments = starts.select("__k", "__cell", F.max("__start").over(
        of_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("__seg"))
    return placed.join(segments, ["__k", "__cell"]).select("__k", "__ts", "__id", F.col("__seg").cast("double").alias("__seg"))


def rate_limit_decisions(df: DataFrame, key_col: str = "ip_address", ts_col: str = "unix_ts",
                         id_col: str = "id", limit: int = DEFAULT_RATE_LIMIT,
                         window: float = DEFAULT_RATE_WINDOW_S, with_order: bool = False) -> DataFrame:
    """(id, admitted) for every request; ``with_order`` adds its time and key (__ts, __k)."""
    keyed = df.select(F.coalesce(F.col(key_col).cast("string"), F.lit(NULL_KEY)).alias("__k"),
                      F.col(ts_col).cast("double").alias("__ts"), F.col(id_col).alias("__id"))
    ordered = (_segments(keyed, int(limit), float(window))
               .repartition("__k", "__seg")
               .sortWithinPartitions("__k", "__seg", "__ts", "__id"))
    id_type = df.schema[id_col].dataType
    out_schema = T.StructType([T.StructField("__id", id_type), T.StructField("admitted", T.BooleanType()),
                               T.StructField("__ts", T.DoubleType()), T.StructField("__k", T.StringType())])
    out = ordered.mapInPandas(_limiter(int(limit), float(window)), out_schema).withColumnRenamed("__id", id_col)
    return out if with_order else out.select(id_col, "admitted")


def rate_limit_admit(df: DataFrame, key_col: str = "ip_address", ts_col: str = "unix_ts",
                     id_col: str = "id", limit: int = DEFAULT_RATE_LIMIT,
                     window: float = DEFAULT_RATE_WINDOW_S) -> DataFrame:
    """Every request with an ``admitted`` flag (denied ones are never scored or stored).

    Decisions are counted per (id, time, key) and joined back by these, so requests that
    repeat an id or have none are spread by time and key. Requests equal in all three are
    in no order: where only some of them are admitted, these are the first by a digest of
    the whole row.
    """
    key = F.coalesce(F.col(key_col).cast("string"), F.lit(NULL_KEY))
    decided = rate_limit_decisions(df, key_col, ts_col, id_col, limit, window, with_order=True)
    groups = (decided.groupBy(F.col(id_col).alias("__gi"), F.col("__ts").alias("__gt"), F.col("__k").alias("__gk"))
              .agg(F.count(F.lit(1)).alias("__n"), F.count_if(F.col("admitted")).alias("__a")))
    same = F.col(id_col).eqNullSafe(F.col("__gi")) & F.col(ts_col).cast("double").eqNullSafe(F.col("__gt")) & (key == F.col("__gk"))
    mixed = (F.col("__a") > 0) & (F.col("__a") < F.col("__n"))
    alike = df.join(groups.filter(~mixed), same).withColumn("admitted", F.col("__a") > 0)
    numbered = _numbered(df.join(groups.filter(mixed), same), df).withColumn("admitted", F.col("__no") <= F.col("__a"))
    return alike.select(*df.columns, "admitted").union(numbered.select(*df.columns, "admitted"))


def _numbered(rows: DataFrame, df: DataFrame) -> DataFrame:
    """Adds ``__no``, the number of a row in its group, by a digest of its columns.

    A group is numbered in SALTS parts by digest, each after the counts of the parts before it.
    """
    plain = [f.name for f in df.schema.fields if not re.search("map<|variant", f.dataType.simpleString())]
    rows = (rows.withColumn("__g", F.struct("__gi", "__gt", "__gk")).withColumn("__h", F.xxhash64(*plain))
            .withColumn("__s", F.pmod(F.col("__h"), F.lit(SALTS))))
    sizes = rows.groupBy("__g", "__s").agg(F.count(F.lit(1)).alias("__c"))
    before = sizes.select("__g", "__s", (F.sum("__c").over(Window.partitionBy("__g").orderBy("__s")) - F.col("__c")).alias("__b"))
    in_part = F.row_number().over(Window.partitionBy("__g", "__s").orderBy("__h"))
    return rows.join(before, ["__g", "__s"]).withColumn("__no", F.col("__b") + in_part)


def rate_limit_denials(decided: DataFrame, key_col: str = "ip_address") -> DataFrame:
    """Requests and 429 denials per key (the null key is its own group)."""
    return decided.groupBy(key_col).agg(F.count(F.lit(1)).alias("requests"),
                                        F.count_if(~F.col("admitted")).alias("denied"))
