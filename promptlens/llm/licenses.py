"""License scans: sparse TF-IDF cosine to templates, then inheritance by path.

Every line of a text that speaks of licensing is a header; equal lines are scored once.
Lines and templates are sparse TF-IDF vectors (inverse document frequency over all header
lines of the corpus), and a line's licence is the template with the highest cosine.
Notices within longer lines or wrapped over lines are found by token windows, of the
template's length, around each word that speaks of licensing. Whole licence files, and
stretches that open like a licence's text, are compared with full licence texts. A file
without a licence of its own takes that of the licence file in its nearest ancestor
directory, by equi-joins of directories.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptlens.llm.common import written
from promptlens.llm.license_texts import FULL_TEXTS

# FIXED VALUES: SPDX ids and notices by which works name their licence.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License (CC BY 4.0)."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under the Creative Commons CC0 1.0 Universal license."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and or modify it under the terms of the GNU General Public License version 3."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Licensed under the MIT license."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "Copyright. All rights reserved."),
)
HEADER = r"(?i)licen[cs]e|copyright|spdx|rights reserved|creative commons|public domain"
TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
THRESHOLD = 0.6
# A window is the best of many and a full text has many common words: both must be nearer.
WINDOW_THRESHOLD = 0.8
TEXT_THRESHOLD = 0.8
# One of them is in every text that HEADER matches, and the tokens by which windows are placed.
NEAR = ("licen", "copyright", "spdx", "reserved", "commons", "domain")
KEY = r"licen[cs]e|copyright|spdx|^(reserved|commons|domain)$"
# Windows begin in stretches of so many tokens, each scored once.
PIECE = 64
# A stretch of text is compared with full texts where it begins with this many tokens of one.
OPENING = 5
# What a line that only reserves rights says.
RESERVED = "Proprietary"
# File names (lower case, without extension) whose licence holds for their directory.
LICENSE_FILES = ("license", "licence", "copying", "unlicense")


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _tokens(df: DataFrame, key: str, text: Column, weight: Column) -> DataFrame:
    return df.select(key, weight.alias("_n"), F.explode(F.regexp_extract_all(_lower(text), F.lit(TOKEN), 0)).alias("token")) \
        .groupBy(key, "token").agg(F.count("*").alias("tf"), F.max("_n").alias("n"))


def _frequencies(lines: DataFrame) -> tuple[DataFrame, Column]:
    """(token, df) over the header ``lines`` (key, line, n), and the weight of a token by its ``df``."""
    df = _tokens(lines, "key", F.col("line"), F.col("n")).groupBy("token").agg(F.sum("n").alias("df"))
    total = lines.agg(F.sum("n")).first()[0] or 0
    return df, F.log((F.lit(float(total)) + 1) / (F.coalesce("df", F.lit(0)) + 1)) + 1


def score_lines(lines: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(key, license, score) of distinct ``lines`` (key, line, n), n being how often the line stands in the corpus.

    Terms carry the key, a digest, and never the line, which may be long.
    """
    spark = lines.sparkSession
    # The templates are a parameter list; all that derives from them alone stays as small.
    notes = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "t int, license string, text string")
    terms = _tokens(lines, "key", F.col("line"), F.col("n"))
    df, idf = _frequencies(lines)
    note_terms = _tokens(notes, "t", F.col("text"), F.lit(1)).join(df, "token", "left").select("t", "token", (F.col("tf") * idf).alias("tw"))
    note_norms = note_terms.groupBy("t").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tn"))
    notes = written(note_terms.join(note_norms, "t").join(notes.select("t", "license"), "t").select("t", "license", "token", (F.col("tw") / F.col("tn")).alias("tw")), "license-notes")
    weighted = written(terms.join(df, "token").select("key", "token", (F.col("tf") * idf).alias("w")), "license-terms")
    norms = weighted.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighted.join(notes, "token").groupBy("key", "t", "license").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.join(norms, "key").withColumn("score", F.round(F.col("dot") / F.col("norm"), 6))
    best = scored.groupBy("key").agg(F.max(F.struct("score", -F.col("t"), "license")).alias("b"))
    return best.select("key", F.col("b.license").alias("license"), F.col("b.score").alias("score"))


def _words_of(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def _pieces(words: str, reach: int) -> Column:
    """The stretches of ``words`` whose first PIECE tokens begin every window, of at most ``reach`` tokens, that holds a token of KEY."""
    return F.expr(f"""transform(array_distinct(flatten(transform(filter(sequence(1, size({words})), i -> size({words}) > 0 and element_at({words}, i) rlike '{KEY}'),
        i -> array(greatest(0, i - {reach}) div {PIECE}, (i - 1) div {PIECE})))), g -> int(g * {PIECE} + 1))""")


def _openings(words: str, openings: dict[tuple[str, ...], list[int]]) -> Column:
    """(i, n): the places, from 1, where ``words`` begin like a full text, and that text's length."""
    found = []
    for opening, lengths in openings.items():
        begins = " and ".join(f"get({words}, i + {k}) = '{t}'" for k, t in enumerate(opening))
        found += [f"transform(filter(sequence(0, size({words})), i -> {begins}), i -> struct(i + 1 as i, {n} as n))" for n in lengths]
    return F.expr(f"concat({', '.join(found)})")


def score_windows(pieces: DataFrame, lines: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(words, best, named): the nearest window of each of the distinct ``pieces`` (words), and the nearest that does not only reserve rights.

    A window begins with a token of its template within the first PIECE tokens, has the
    template's length and holds a token of KEY. Token weights are those of the header
    ``lines``. Windows are places in a piece, whose size is bounded; a piece meets only the
    templates that share enough weight with it.
    """
    spark = pieces.sparkSession
    df, idf = _frequencies(lines)
    df = written(df.select("token", idf.alias("idf")), "license-idf")
    rare = float(lines.agg(F.coalesce(F.log(F.sum("n") + 1.0), F.lit(0.0)) + 1).first()[0])
    notes = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "t int, license string, text string")
    weighted = written(_tokens(notes, "t", F.col("text"), F.lit(1)).join(df, "token", "left").select("t", "token", "tf", (F.col("tf") * F.coalesce("idf", F.lit(rare))).alias("tw")), "license-window-terms")
    weights = weighted.groupBy("t").agg(F.map_from_entries(F.collect_list(F.struct("token", "tw"))).alias("tw"), F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tn"),
                                        F.sum("tf").cast("int").alias("l"))
    weights = written(weights.join(notes.select("t", "license"), "t"), "license-windows")
    pieces = written(pieces.select("words", F.monotonically_increasing_id().alias("id")), "license-pieces")
    spread = pieces.select("id", F.posexplode(F.split("words", " ")).alias("i", "token")).join(df, "token", "left")
    spread = written(spread.select("id", "i", "token", F.coalesce("idf", F.lit(rare)).alias("w"), F.col("token").rlike(KEY).alias("key")), "license-places")
    placed = spread.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("i", "token", "w", "key"))).alias("x"))
    # No window's cosine exceeds the share of the template's norm that lies in the tokens of the piece.
    share = F.sqrt(F.sum(F.col("tw") * F.col("tw")))
    met = spread.select("id", "token").distinct().join(weighted.select("t", "token", "tw"), "token").groupBy("id", "t").agg(share.alias("share")) \
        .join(weights.select("t", "tn"), "t").where(F.col("share") >= (WINDOW_THRESHOLD - 1e-6) * F.col("tn")).select("id", "t")
    dot = "aggregate(slice(x, i, l), 0D, (s, e) -> s + e.w * coalesce(tw[e.token], 0D))"
    # Repeated tokens only add to a window's length, so the sum over places bounds its cosine.
    least = "sqrt(aggregate(slice(x, i, l), 0D, (s, e) -> s + e.w * e.w))"
    norm = "sqrt(aggregate(slice(x, i, l), 0D, (s, e) -> s + e.w * e.w * size(filter(slice(x, i, l), o -> o.token = e.token))))"
    every = placed.join(met, "id").join(weights, "t") \
        .withColumn("starts", F.expr(f"filter(sequence(1, {PIECE}), i -> i + l - 1 <= size(x) and map_contains_key(tw, get(x, i - 1).token) and exists(slice(x, i, l), e -> e.key))"))
    near = every.withColumn("starts", F.expr(f"filter(starts, i -> {dot} >= {WINDOW_THRESHOLD - 1e-6} * tn * {least})")).where("size(starts) > 0")
    scored = near.withColumn("score", F.expr(f"array_max(transform(starts, i -> round({dot} / (tn * {norm}), 6)))")).where(F.col("score") >= WINDOW_THRESHOLD)
    # Equal scores go by name, so that the cut into pieces decides nothing.
    found = F.struct("score", "license")
    best = scored.groupBy("id").agg(F.max(found).alias("b"), F.max(F.when(F.col("license") != RESERVED, found)).alias("c"))
    return best.join(pieces, "id").select("words", F.col("b").alias("best"), F.col("c").alias("named"))


def score_texts(texts: DataFrame, lines: DataFrame, full=FULL_TEXTS) -> DataFrame:
    """(id, license, score) of distinct ``texts`` (text; tokens with a space between): the nearest full text, from TEXT_THRESHOLD on.

    Token weights are those of the header ``lines``; a token counts by 1 + ln of its number.
    """
    spark = texts.sparkSession
    df, idf = _frequencies(lines)
    w = (1 + F.log(F.col("tf").cast("double"))) * idf
    notes = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(full)], "t int, license string, text string")
    terms = _tokens(notes, "t", F.col("text"), F.lit(1)).join(df, "token", "left").select("t", "token", w.alias("tw"))
    norms = terms.groupBy("t").agg(F.sqrt(F.sum(F.col("tw") * F.col("tw"))).alias("tn"))
    notes = written(terms.join(norms, "t").join(notes.select("t", "license"), "t").select("t", "license", "token", (F.col("tw") / F.col("tn")).alias("tw")), "license-texts")
    texts = texts.withColumn("id", F.sha2("text", 256))
    weighted = written(_tokens(texts, "id", F.col("text"), F.lit(1)).join(df, "token", "left").select("id", "token", w.alias("w")), "license-text-terms")
    norms = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighted.join(F.broadcast(notes), "token").groupBy("id", "t", "license").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scored = dots.join(norms, "id").withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= TEXT_THRESHOLD)
    best = scored.groupBy("id").agg(F.max(F.struct("score", -F.col("t"), "license")).alias("b"))
    return best.select("id", F.col("b.license").alias("license"), F.col("b.score").alias("score"))


def scan_licenses(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text",
                  templates=TEMPLATES, threshold: float = THRESHOLD, full=FULL_TEXTS) -> DataFrame:
    """One row per input row: doc_id, path, n_headers, score, own_license, license, inherited_from.

    ``score`` is the best cosine of the file's header lines and windows (0 without any),
    ``own_license`` its template from ``threshold`` on; of equal templates a line takes the earlier, and of
    equal lines and windows the last name counts. A full
    text goes before both, and a window before a line that only reserves rights; ``score`` is
    that of the licence taken. ``license`` is the own
    one, or that of the licence file in the nearest ancestor directory (``inherited_from``; of
    several there the best score, then the first licence name). A null text has no headers, a
    null path no ancestors; a very long text is cut into pieces of bounded size, whose number
    grows with it; repeated rows get equal results; an empty table gives no rows; other
    columns are not read.
    """
    line = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x.rlike(HEADER))
    reach = max(len(_words_of(t)) for _, t in templates)
    openings: dict[tuple[str, ...], list[int]] = {}
    for _, t in full:
        openings.setdefault(tuple(_words_of(t)[:OPENING]), []).append(len(_words_of(t)))
    base = F.regexp_extract(_lower(F.col("path")), r"([^/]*?)(\.[^/.]*)?$", 1)
    none = lambda kind: F.array().cast(f"array<{kind}>")
    rows = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text")) \
        .withColumn("is_license", F.coalesce(base.isin(*LICENSE_FILES), F.lit(False))) \
        .withColumn("low", F.lower("text"))
    # Plain searches first: few texts pass, and only these are split or searched by expressions.
    holds = lambda words: reduce(and_, [F.col("low").contains(w) for w in words])
    rows = rows.withColumn("near", reduce(or_, [holds([w]) for w in NEAR])) \
        .withColumn("opens", reduce(or_, [holds(sorted(set(o), key=lambda w: (-len(w), w))) for o in openings])).drop("low")
    rows = rows.withColumn("words", F.when(F.col("is_license") | F.col("near") | F.col("opens"), F.regexp_extract_all(_lower(F.col("text")), F.lit(TOKEN), 0))
                           .otherwise(none("string")))
    rows = rows.select("doc_id", "path", "is_license", "near", "opens", F.monotonically_increasing_id().alias("row"), "words",
                       F.when(F.col("near") & F.col("text").rlike(HEADER), line).otherwise(none("string")).alias("lines"))
    rows = written(rows, "license-files")
    headers = rows.select("row", F.explode("lines").alias("line")).withColumn("key", F.sha2("line", 256))
    lines = written(headers.groupBy("key", "line").agg(F.count("*").alias("n")), "license-lines")
    own = headers.select("row", "key").join(score_lines(lines, templates), "key").groupBy("row").agg(F.max(F.struct("score", "license")).alias("b"))
    # Places are generated row by row, and only then cut: no row holds its pieces or stretches together.
    some = rows.where("size(words) > 0")
    cut = lambda i, n: F.array_join(F.slice("words", F.col(i), F.col(n) if isinstance(n, str) else F.lit(n)), " ")
    pieces = written(some.where("near").select("row", "words", F.explode(_pieces("words", reach)).alias("i")).select("row", cut("i", PIECE + reach - 1).alias("words")), "license-row-pieces")
    by_window = pieces.join(score_windows(pieces.select("words").distinct(), lines, templates), "words") \
        .groupBy("row").agg(F.max("best").alias("v"), F.max("named").alias("named"))
    texts = some.where("is_license").select("row", F.array_join("words", " ").alias("text")) \
        .unionByName(some.where("opens").select("row", "words", F.inline(_openings("words", openings))).select("row", cut("i", "n").alias("text")))
    texts = written(texts.withColumn("id", F.sha2("text", 256)), "license-row-texts")
    by_text = texts.select("row", "id").distinct().join(score_texts(texts.select("text").distinct(), lines, full), "id") \
        .groupBy("row").agg(F.max(F.struct("score", "license")).alias("full"))
    best = F.greatest("b", "v")
    best = F.coalesce("full", F.when((best["license"] == RESERVED) & F.col("named").isNotNull(), F.col("named")).otherwise(best))
    sure = F.col("best.score") >= threshold
    found = rows.join(own, "row", "left").join(by_window, "row", "left").join(by_text, "row", "left").withColumn("best", best)
    found = written(found.select(
        "doc_id", "path", F.size("lines").cast("long").alias("n_headers"), F.coalesce("best.score", F.lit(0.0)).alias("score"),
        F.when(sure, F.col("best.license")).alias("own_license"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), "is_license"), "license-own")
    by_dir = found.where("is_license and own_license is not null").groupBy("dir") \
        .agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("own_license").alias("license"))).alias("b")) \
        .select(F.col("dir").alias("ancestor"), F.col("b.license").alias("license"))
    # Each directory looks up its ancestors once; files then join their directory.
    parts = F.split("dir", "/")
    dirs = found.select("dir").where("dir is not null").distinct().select("dir", F.explode(F.transform(
        F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("ancestor"))
    nearest = dirs.distinct().join(by_dir, "ancestor").groupBy("dir").agg(F.max(F.struct(F.length("ancestor").alias("n"), "ancestor", "license")).alias("b"))
    out = found.join(nearest, "dir", "left")
    return out.select("doc_id", "path", "n_headers", "score", "own_license", F.coalesce("own_license", "b.license").alias("license"),
                      F.when(F.col("own_license").isNull(), F.col("b.ancestor")).alias("inherited_from"))
