"""URL filters: longest-rule verdicts, and gradient-boosted trees where no rule fits.

The trees see lexical features only (length, depth, digit ratio, entropy, parameter
counts) and suffix statistics: how often labelled URLs with the same top-level label,
domain or first directory are blocked. The rules label the URLs that they fit; the
trees are fitted on a bounded hash sample of labelled URLs, the statistics on all.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptlens.llm.common import written

# FIXED VALUES: the rules, host suffix and path prefix.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
# Bound of the training sample (expected rows), trees and their depth.
TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 20, 4, 17
# Pseudo-count by which rare suffixes keep to the overall rate.
PRIOR = 20.0
SUFFIXES = ("tld", "domain", "section")
FEATURES = ("f_length", "f_host_length", "f_depth", "f_labels", "f_digits", "f_letters", "f_entropy", "f_params", "f_hyphens",
            *(f"f_{s}" for s in SUFFIXES))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, say in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        suffix, slash, start = text.partition("/")
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return rule, verdict


def parsed(pages: DataFrame, id_col: str, url_col: str, rules) -> DataFrame:
    url = F.col("url")
    host, path = host_and_path(url)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return (pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
            .withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))
            .withColumn("rule", rule).withColumn("said", verdict))


def lexical(df: DataFrame) -> DataFrame:
    """Add the lexical features and the suffix keys of column ``url`` (with ``host`` and ``path``)."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.length(url)
    per = lambda c: F.when(n > 0, c / n).otherwise(0.0)
    chars = F.split(url, "")
    # Entropy of the characters: log n - (1/n) * sum of c * log c.
    spread = F.aggregate(F.transform(F.array_distinct(chars), lambda c: n - F.length(F.replace(url, c, F.lit("")))), F.lit(0.0),
                         lambda a, c: a + F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(0.0))
    labels = F.split("host", r"\.")
    last = lambda k: F.coalesce(F.try_element_at(labels, F.lit(-k)), F.lit(""))
    return df.select(
        "*", n.cast("double").alias("f_length"), F.length("host").cast("double").alias("f_host_length"),
        F.regexp_count("path", F.lit("/[^/]+")).cast("double").alias("f_depth"), F.size(labels).cast("double").alias("f_labels"),
        per(F.regexp_count(url, F.lit("[0-9]"))).alias("f_digits"), per(F.regexp_count(url, F.lit("[A-Za-z]"))).alias("f_letters"),
        F.when(n > 0, F.log2(n.cast("double")) - spread / n).otherwise(0.0).alias("f_entropy"),
        F.regexp_count(url, F.lit("[?&][^?&#=]+=")).cast("double").alias("f_params"), F.regexp_count("host", F.lit("-")).cast("double").alias("f_hyphens"),
        last(1).alias("tld"), F.concat_ws(".", last(2), last(1)).alias("domain"), F.regexp_extract("path", "^/([^/]*)", 1).alias("section"))


def suffix_statistics(labelled: DataFrame) -> dict[str, DataFrame]:
    """Per suffix kind (suffix, rate): smoothed share of blocked URLs among all labelled ones."""
    total = labelled.agg(F.avg((F.col("said") == "block").cast("double"))).first()[0] or 0.0
    return {s: written(labelled.groupBy(s).agg(((F.sum((F.col("said") == "block").cast("long")) + PRIOR * total)
                                                / (F.count("*") + PRIOR)).alias(f"f_{s}")), f"url-{s}") for s in SUFFIXES} | {"": total}


def with_statistics(df: DataFrame, stats: dict) -> DataFrame:
    for s in SUFFIXES:
        df = df.join(stats[s], s, "left").withColumn(f"f_{s}", F.coalesce(f"f_{s}", F.lit(stats[""])))
    return df


def fit(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[GBTClassificationModel | str, dict]:
    """(trees, suffix statistics) from rows with lexical features and ``said``.

    With labels of one class only the verdict is that class; without labels, "allow".
    """
    stats = suffix_statistics(labelled)
    counts = {r[0]: r[1] for r in labelled.groupBy("said").count().collect()}
    if len(counts) < 2:
        return next(iter(counts), "allow"), stats
    slots = 1 << 20
    rate = min(slots, int(slots * train_rows / sum(counts.values())))
    sample = labelled.where(F.pmod(F.xxhash64("url", F.lit(SEED)), F.lit(slots)) < rate)
    sample = with_statistics(sample, stats).select(*FEATURES, (F.col("said") == "block").cast("double").alias("label"))
    sample = _assembled(written(sample.repartition(4, *FEATURES), "url-sample")).select("features", "label")
    if sample.select("label").distinct().count() < 2:
        return max(counts, key=counts.get), stats
    return GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, maxBins=32, cacheNodeIds=False).fit(sample), stats


def _assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)


def judge(df: DataFrame, model: GBTClassificationModel | str, stats: dict) -> DataFrame:
    """Add ``learned`` (allow or block) to rows with lexical features."""
    if isinstance(model, str):
        return df.withColumn("learned", F.lit(model))
    return model.transform(_assembled(with_statistics(df, stats))).withColumn("learned", F.when(F.col("prediction") == 1.0, "block").otherwise("allow"))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict.

    A null url or one without ``://`` has an empty host and path, fits no rule and is judged
    by the trees on its empty features. Repeated rows get equal verdicts; an empty table
    gives no rows; other columns are not read.
    """
    rows = written(lexical(parsed(pages, id_col, url_col, rules)), "url-rows")
    model, stats = fit(rows.where("said is not null"), train_rows)
    ruled = rows.where("said is not null").select("page_id", "host", "path", "rule", F.col("said").alias("verdict"))
    free = judge(rows.where("said is null"), model, stats).select("page_id", "host", "path", "rule", F.col("learned").alias("verdict"))
    return ruled.unionByName(free)
