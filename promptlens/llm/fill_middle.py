"""Fill-in-middle transformation: a counted-quantifier expression cuts each text in one match.

``regexp_count`` gives a text's number n of units (code points). Two hashes of the row's id
give the cuts a and b, and the row's own pattern, ``unit{a}`` and ``unit{b-a}`` in possessive
groups, captures prefix, middle and suffix in a single match, whose replacement is the
output. Everything is a projection of built-in functions: nothing moves between tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# One unit: any code point, line ends included. Units are counted in blocks first.
UNIT, BLOCK = ".", 4096


@dataclass(frozen=True)
class Format:
    """Markers of the three parts, and how many of 100 rows are rearranged, and of these suffix-first."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    rate: int = 90
    suffix_first: int = 20
    seed: str = "1:"


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def _inserted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def count_units(text: Column) -> Column:
    """Number of code points of ``text``: whole blocks, then the rest, so that no match list is longer than one block or the number of blocks."""
    blocks = F.regexp_count(text, F.lit(f"(?s){UNIT}{{{BLOCK}}}+")).cast("long")
    rest = F.substring(text, (blocks * BLOCK + 1).cast("int"), F.lit(BLOCK))
    return blocks * BLOCK + F.regexp_count(rest, F.lit(f"(?s){UNIT}")).cast("long")


def restore(output: Column, form: Column, fmt: Format = Format()) -> Column:
    """The exact text of an ``output`` by its ``form``: texts that hold a marker are never rearranged, so each marker is the first of its kind."""
    p, s, m = map(_quoted, (fmt.prefix, fmt.suffix, fmt.middle))
    return (F.when(form == "psm", F.regexp_replace(output, F.lit(f"(?s)\\A{p}(.*?){s}(.*?){m}(.*+)\\z"), F.lit("$1$3$2")))
            .when(form == "spm", F.regexp_replace(output, F.lit(f"(?s)\\A{s}(.*?){p}(.*?){m}(.*+)\\z"), F.lit("$2$3$1")))
            .otherwise(output))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fmt: Format = Format()) -> DataFrame:
    """One row per input row: doc_id, n, form, prefix_chars, middle_chars, output.

    ``form`` is plain (the text itself), psm (prefix, suffix, middle) or spm (suffix, prefix,
    middle). Cuts and form depend on the id and n alone, so reruns and repeated rows agree. A
    null text is empty; an empty text, or one that holds a marker, stays plain, with null
    prefix_chars and middle_chars. A null id is hashed as an empty number. Texts of any length
    are cut whole. An empty table gives no rows; other columns are not read.
    """
    key = F.sha2(F.concat(F.lit(fmt.seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(F.col("_key"), 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    text = F.col("text")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), key.alias("_key")) \
        .withColumn("n", count_units(text))
    marked = text.contains(fmt.prefix) | text.contains(fmt.suffix) | text.contains(fmt.middle)
    form = F.when((F.col("n") == 0) | (h[2] % 100 >= fmt.rate) | marked, "plain").when(h[3] % 100 < fmt.suffix_first, "spm").otherwise("psm")
    cuts = [h[i] % (F.col("n") + 1) for i in range(2)]
    rows = rows.select("doc_id", "text", "n", form.alias("form"), F.least(*cuts).alias("_a"), F.greatest(*cuts).alias("_b"))
    a, b, moved = F.col("_a"), F.col("_b"), F.col("form") != "plain"
    pattern = F.concat(F.lit(f"(?s)\\A({UNIT}{{"), a, F.lit(f"}}+)({UNIT}{{"), b - a, F.lit(f"}}+)({UNIT}*+)\\z"))
    p, s, m = map(_inserted, (fmt.prefix, fmt.suffix, fmt.middle))
    order = F.when(F.col("form") == "psm", f"{p}$1{s}$3{m}$2").otherwise(f"{s}$3{p}$1{m}$2")
    return rows.select("doc_id", "n", "form", F.when(moved, a).alias("prefix_chars"), F.when(moved, b - a).alias("middle_chars"),
                       F.when(moved, F.regexp_replace(text, pattern, order)).otherwise(text).alias("output"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fmt: Format = Format()) -> DataFrame:
    """``fill_in_middle`` with its output, and the text restored from it, as lowercase SHA-256."""
    return fill_in_middle(docs, id_col, text_col, fmt).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form"), fmt), 256).alias("restored_sha256"))
