"""Quality rules: text statistics and a learned decision list.

Statistics are computed in the row, with array functions over the whole text. A decision
list is learned from labelled statistics by sequential covering: a rule grows one
threshold condition at a time on two thirds of the uncovered rows, is pruned on the
last third, and covers what it matches before the next rule grows. Each step counts
binned statistics in one small aggregate. The list becomes one ordered CASE expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptlens.llm.common import WORD, written

# FIXED VALUES: the base rule.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
# Bound of the training sample (expected rows), and of the list.
TRAIN_ROWS = 20_000
MAX_RULES, MAX_CONDITIONS, BINS = 8, 4, 24
# A rule must hold on so many rows that prune it, with this share of bad texts.
MIN_SUPPORT, MIN_PRECISION = 5, 0.8
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("n_words", "mean_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "digit_share",
            "wordless_share", "marks_per_word")


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= self.threshold if self.at_least else c < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, STATS and the features of the decision list. A null text has no words."""
    text = F.col("text")
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_of = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("long")
    df = df.select(
        "doc_id", F.regexp_extract_all(text, F.lit(WORD), 0).alias("w"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)).alias("lines"),
        n_of(r"[\x20\x09-\x0D]+").alias("word_chars"), n_of(r"[^#*$%&|<>]+").alias("n_symbols"), n_of(r"\P{Lu}+").alias("n_upper"),
        n_of(r"[^0-9]+").alias("n_digits"), n_of(r"[^!?]+").alias("n_marks"))
    n = F.size("w")
    # Windows as (hash, place); equal windows are neighbours once sorted.
    windows = F.expr(f"""case when size(w) >= {WINDOW} then sort_array(transform(sequence(0, size(w) - {WINDOW}),
        i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) as h, i as i))) else array() end""")
    df = df.select("doc_id", "word_chars", "n_symbols", "n_upper", "n_digits", "n_marks", n.cast("long").alias("n_words"),
                   F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
                   F.size(F.filter("w", lambda x: ~x.rlike(r"[\p{L}\p{N}]"))).cast("long").alias("n_wordless"), windows.alias("s"))
    places = F.expr("""sort_array(transform(filter(s, (x, j) ->
        (j > 0 and s[greatest(j - 1, 0)].h = x.h) or (j < size(s) - 1 and s[least(j + 1, size(s) - 1)].h = x.h)), x -> x.i))""")
    df = df.withColumn("p", places).drop("s")
    covered = F.expr(f"aggregate(transform(p, (x, j) -> if(j = 0, {WINDOW}, least({WINDOW}, x - p[greatest(j - 1, 0)]))), 0L, (a, x) -> a + x)")
    df = df.withColumn("n_repeat_words", covered).drop("p")
    per = lambda c, d: F.when(F.col(d) > 0, F.col(c) / F.col(d)).otherwise(0.0)
    return df.select(
        "doc_id", *STATS, per("word_chars", "n_words").alias("mean_word"), per("n_symbols", "n_words").alias("symbols_per_word"),
        per("n_dup_lines", "n_lines").alias("dup_line_share"), per("n_repeat_words", "n_words").alias("repeat_share"),
        per("n_upper", "word_chars").alias("upper_share"), per("n_digits", "word_chars").alias("digit_share"),
        per("n_wordless", "n_words").alias("wordless_share"), per("n_marks", "n_words").alias("marks_per_word"))


def _matches(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def _gain(bad: float, good: float, bad0: float, good0: float) -> float:
    """FOIL's gain of a rule that covered (bad0, good0) and now covers (bad, good)."""
    if not bad:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad0 / (bad0 + good0)))


def _grow(rows: DataFrame, cuts: dict[str, list[float]]) -> Rule:
    rule: Rule = ()
    while len(rule) < MAX_CONDITIONS:
        # The bin of a value is the number of cuts at or below it; at most BINS + 1 rows per feature come back.
        long = rows.where(_matches(rule)).select("bad", F.inline(F.array(*[F.struct(
            F.lit(f).alias("feature"), sum((F.when(F.col(f) >= c, 1).otherwise(0) for c in cuts[f]), F.lit(0)).alias("bin")) for f in cuts])))
        counts: dict[str, list[list[int]]] = {f: [[0, 0] for _ in range(len(cuts[f]) + 1)] for f in cuts}
        for f, b, bad, n in long.groupBy("feature", "bin").agg(F.sum("bad"), F.count("*")).collect():
            counts[f][b] = [bad, n - bad]
        bad0, good0 = (sum(x[k] for x in counts[FEATURES[0]]) for k in (0, 1)) if FEATURES[0] in counts else (0, 0)
        if not bad0 or not good0:
            return rule
        best, chosen = 1e-9, None
        for f in cuts:
            for k, cut in enumerate(cuts[f]):
                for at_least, part in ((True, counts[f][k + 1:]), (False, counts[f][:k + 1])):
                    gain = _gain(sum(x[0] for x in part), sum(x[1] for x in part), bad0, good0)
                    if gain > best:
                        best, chosen = gain, Condition(f, at_least, cut)
        if chosen is None:
            return rule
        rule += (chosen,)
    return rule


def _prune(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The prefix of ``rule`` with the best (bad - good) / (bad + good), and what it covers."""
    aggs = [x for k in range(1, len(rule) + 1) for x in (F.sum(F.when(_matches(rule[:k]), F.col("bad"))), F.sum(F.when(_matches(rule[:k]), 1 - F.col("bad"))))]
    got = [x or 0 for x in rows.agg(*aggs).first()]
    pairs = [(got[2 * k], got[2 * k + 1]) for k in range(len(rule))]
    worth = [(b - g) / (b + g) if b + g else -1.0 for b, g in pairs]
    k = max(range(len(rule)), key=lambda i: (worth[i], -i))
    return rule[:k + 1], *pairs[k]


def learn(stats: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> list[Rule]:
    """A decision list of rules for bad texts from ``labels`` (doc_id, bad 0/1); [] without labels of both kinds."""
    total = labels.count()
    slots = 1 << 20
    rate = min(slots, int(slots * train_rows / max(total, 1)))
    chosen = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(slots)) < rate)
    sample = written(stats.join(chosen, "doc_id").where(F.col("n_words") >= MIN_WORDS)
                     .select(*FEATURES, F.col("bad").cast("int").alias("bad"), (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0).alias("prune"))
                     .coalesce(4), "rules-sample")
    points = [k / BINS for k in range(1, BINS)]
    # Cuts at the quantiles of the bad texts and of all, so that both tails are covered.
    cut_rows = sample.agg(*[F.percentile_approx(f, points, 10_000) for f in FEATURES]).first()
    bad_rows = sample.where("bad = 1").agg(*[F.percentile_approx(f, [0.02, 0.1, 0.25, 0.5, 0.75, 0.9, 0.98], 10_000) for f in FEATURES]).first()
    cuts = {f: sorted({float(x) for x in [*(cut_rows[i] or []), *(bad_rows[i] or [])]}) for i, f in enumerate(FEATURES)}
    rules: list[Rule] = []
    for _ in range(MAX_RULES):
        rest = sample
        for r in rules:
            rest = rest.where(~_matches(r))
        rule = _grow(rest.where("not prune"), cuts)
        if not rule:
            break
        rule, bad, good = _prune(rest.where("prune"), rule)
        if bad + good < MIN_SUPPORT or bad < MIN_PRECISION * (bad + good):
            break
        rules.append(rule)
    return rules


def decision(rules: list[Rule]) -> Column:
    """The first rule that matches, as text; null if none does."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(_matches(r), " and ".join(map(str, r))).otherwise(out)
    return out


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "quality", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per input row: doc_id, STATS, base_failed, kept, rule.

    ``kept`` is false where the base rule fails or a learned rule (column ``rule``) matches.
    A null or empty text has no words and fails the base rule. Labels that are null or whose
    document is missing teach nothing; without labels only the base rule counts. Repeated rows
    give repeated results, an empty table none; other columns are not read.
    """
    stats = written(statistics(docs, id_col, text_col), "rules-stats")
    marked = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("doc_id"), (F.col(label_col) == 0).cast("int").alias("bad"))
    rules = learn(stats, marked, train_rows)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return stats.select("doc_id", *STATS, failed.alias("base_failed"), decision(rules).alias("rule"))\
        .select("doc_id", *STATS, "base_failed", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"), "rule")
