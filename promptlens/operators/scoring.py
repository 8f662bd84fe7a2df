"""Text scoring: injection phrases, custom policy rules, PII redaction, verdicts.

All operators are narrow (no shuffle): a prompt's verdict depends on its own
text only. Expensive expressions are materialised in their own projection so
Catalyst's CollapseProject does not duplicate them into every consumer.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptlens.functions import rules as R
from promptlens.functions.text import payload_bytes, snippet
from promptlens.operators import rule_search as RS
from promptlens.session import scratch_path

# Custom rules: so many of the first ones, with so many characters in all, go to every task;
# only texts that hold none of them meet the rest.
RULES_IN_TASK, RULE_CHARS = 1 << 15, 1 << 22
# Texts are searched in blocks of so many bytes, whatever their length.
RULE_BLOCK = 1 << 16


def injection_scan(df: DataFrame, text_col: str = "prompt") -> DataFrame:
    """Adds blocked, severity, matched_rule from the 18 built-in phrases (first hit wins)."""
    v = "__inj"
    out = df.withColumn(v, R.injection_verdict(F.coalesce(F.col(text_col), F.lit(""))))
    return (out.withColumn("blocked", F.col(v).isNotNull())
               .withColumn("severity", F.col(f"{v}.severity"))
               .withColumn("matched_rule", F.col(f"{v}.rule"))
               .drop(v))


def injection_all_hits(df: DataFrame, text_col: str = "prompt") -> DataFrame:
    """One row per (prompt, phrase contained in it): rank, term, severity, rule."""
    hits = R.injection_all_hits(F.coalesce(F.col(text_col), F.lit("")))
    return (df.select("*", F.explode(hits).alias("__hit"))
              .select(*[c for c in df.columns if c != text_col],
                      F.col("__hit.rank").alias("term_rank"), F.col("__hit.term").alias("term"),
                      F.col("__hit.severity").alias("severity"), F.col("__hit.rule").alias("matched_rule")))


def _enabled_rules(rules_df: DataFrame) -> DataFrame:
    return rules_df.filter(F.col("enabled") & (F.length("pattern") > 0))


def load_policy_rules(rules_df: DataFrame) -> DataFrame:
    """The enabled custom rules with a pattern, ready for ``score_prompts(custom_rules=...)``."""
    return _enabled_rules(rules_df)


def score_prompts(df: DataFrame, text_col: str = "prompt", *, enable_injection: bool | Column = True,
                  enable_pii: bool | Column = True,
                  custom_rules: DataFrame | None = None,
                  key_col: str | None = None) -> DataFrame:
    """Full verdict per prompt.

    Adds status, severity, matched_rule, sanitized_text, tokens_masked:
    BLOCKED (first built-in phrase, then first enabled custom rule; text kept,
    0 masked), else SANITIZED when the PII alternation matches (MEDIUM), else
    PASSED (LOW, no rule). The regex runs on unblocked rows only, and the
    replacement only on rows whose count is positive. The switches may be columns
    (settings in force at each row). ``key_col`` is not read: custom rules meet
    prompts by their text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    if isinstance(enable_injection, Column):
        verdict = F.when(enable_injection, R.injection_verdict(text))
    else:
        verdict = (R.injection_verdict(text) if enable_injection
                   else F.lit(None).cast("struct<severity:string,rule:string,rank:int>"))
    out = df.withColumn("__v", verdict)
    if custom_rules is not None:
        out = _apply_custom_rules(out, text_col, custom_rules)
    if isinstance(enable_pii, Column) or enable_pii:
        wanted = F.col("__v").isNull() & enable_pii if isinstance(enable_pii, Column) else F.col("__v").isNull()
        out = _redact_once(out.withColumn("__r", F.when(wanted, R.pii_redact(text))), text)
        # The verdicts leave a generator: a filter on a column made from them stays above it,
        # where it would else be pushed below with a copy of every regex for each reference.
        made = F.explode(F.array(F.struct("__r", F.coalesce(F.col("__n"), F.lit(0)).alias("__n")))).alias("__p")
        out = out.select(*[c for c in out.columns if c not in ("__r", "__n")], made)
        out = out.withColumn("__r", F.col("__p.__r")).withColumn("__n", F.col("__p.__n")).drop("__p")
    else:
        out = out.withColumn("__r", F.lit(None).cast("string")).withColumn("__n", F.lit(0))
    blocked = F.col("__v").isNotNull()
    n = F.col("__n")
    return (out.withColumns({
        "status": F.when(blocked, F.lit(R.STATUS_BLOCKED))
                   .when(n > 0, F.lit(R.STATUS_SANITIZED)).otherwise(F.lit(R.STATUS_PASSED)),
        "severity": F.when(blocked, F.col("__v.severity"))
                     .when(n > 0, F.lit("MEDIUM")).otherwise(F.lit("LOW")),
        "matched_rule": F.when(blocked, F.col("__v.rule"))
                         .when(n > 0, F.lit(R.PII_RULE_LABEL)),
        "sanitized_text": F.when(n > 0, F.col("__r")).otherwise(text),
        "tokens_masked": n.cast("int"),
    }).drop("__v", "__n", "__r"))


def _redact_once(df: DataFrame, text: Column) -> DataFrame:
    """Adds ``__n`` = replacements made in ``__r`` (the redacted text), without a second regex pass.

    Every replacement inserts one mark, and the mark cannot straddle a
    replacement boundary ('[' and ']' occur only at its ends), so the marks in
    the output are the replacements — unless the input already held the mark
    text, in which case the matches are counted by the regex itself.
    """
    r = F.col("__r")
    return df.withColumn("__n", F.when(r.isNull(), F.lit(None))
                         .when(text.contains(R.REDACTION_MARK), R.pii_count(text))
                         .otherwise(R.marks_in(r)))


def _apply_custom_rules(df: DataFrame, text_col: str, rules: DataFrame) -> DataFrame:
    """Puts the first enabled rule (by created_at, id) contained in each text behind the built-in verdicts.

    Equal patterns are merged, the first one counts. The first rules in order, a bounded list,
    are looked for in the row itself. Where there are more, the texts that hold none of these
    meet the rest by anchors (``_rest_join``): a text that is decided needs no later rule, so
    that a text does not meet every rule that it contains.
    """
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    spark, order = df.sparkSession, ["__o", "__p"]
    merged = _written(_merged_rules(_enabled_rules(rules)), "rules")
    size = F.length("__p") + F.coalesce(F.length("__r.severity"), F.lit(0)) + F.coalesce(F.length("__r.rule"), F.lit(0))
    sizes = [r[0] for r in merged.orderBy(*order).limit(RULES_IN_TASK).select(size).collect()]
    if not sizes:
        return df
    n = sum(total <= RULE_CHARS for total in accumulate(sizes))
    first = merged.orderBy(*order).limit(n).select("__p", "__r.severity", "__r.rule").collect() if n else []
    verdict = lambda made, severity, rule: F.when(made, F.struct(severity.alias("severity"), rule.alias("rule"), F.lit(None).cast("int").alias("rank")))
    out, found = df.withColumn("__no", F.lit(-1)), [F.col("__v")]
    if n:
        names = spark.createDataFrame([(i, r[1], r[2]) for i, r in enumerate(first)], "__no int, __severity string, __rule string")
        out = df.withColumn("__no", _first_rule(spark, [r[0] for r in first])(low))
        found.append(verdict(F.col("__no") >= 0, F.col("__severity"), F.col("__rule")))
    undecided = out.filter("__no < 0").select(_text_key(low).alias("__key"), low.alias("__lt"))
    if n:
        out = out.join(F.broadcast(names), "__no", "left")
    if merged.count() > n:
        rest = merged.join(F.broadcast(merged.orderBy(*order).limit(n).select("__id")), "__id", "left_anti")
        out = out.withColumn("__key", _text_key(low)).join(_rest_join(undecided, rest), "__key", "left")
        found.append(verdict(F.col("__c").isNotNull(), F.col("__c.severity"), F.col("__c.rule")))
    return out.withColumn("__v", F.coalesce(*found)).drop("__no", "__severity", "__rule", "__key", "__c")


def _merged_rules(rules: DataFrame) -> DataFrame:
    """One numbered row per pattern in lower case: __p, its first rule's order __o and __r (severity, rule)."""
    order = F.struct("created_at", "id")
    return (rules.select(F.lower(F.col("pattern")).alias("__p"), order.alias("__o"), F.struct("severity", F.col("name").alias("rule")).alias("__r"))
            .groupBy("__p").agg(F.min("__o").alias("__o"), F.min_by("__r", "__o").alias("__r"))
            .withColumn("__id", F.monotonically_increasing_id()))


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _text_key(text: Column) -> Column:
    """The verdict depends on the text alone, so the caller's ids (null, repeated or none) play no part."""
    return F.unhex(F.sha2(text, 256))


def _first_rule(spark: SparkSession, patterns: list[str]):
    """A function of a text: the number of the first of ``patterns`` that it contains, or -1."""
    search, block = spark.sparkContext.broadcast(RS.FirstRule(patterns)), RULE_BLOCK

    @F.arrow_udf("int")
    def first_rule(texts: pa.Array) -> pa.Array:
        return pa.array(search.value.first(*RS.strings(texts), block), pa.int32())

    return first_rule


def _anchors(df: DataFrame, key: str, kinds: list[int], own: bool, bits: np.ndarray | None = None) -> DataFrame:
    """(``key``, __g) for the anchors of column 1 of ``df``, the text; ``own``: those of a rule of that size alone."""
    block, held = RULE_BLOCK, None if bits is None else df.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = RS.strings(b.column(1))
            kind = RS.kind_of(np.diff(offsets))
            for k, text, anchor in RS.anchors(raw, offsets, kinds, block, None if held is None else held.value):
                if own:
                    text, anchor = text[kind[text] == k], anchor[kind[text] == k]
                if len(text):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text)), pa.array(anchor)], names=[key, "__g"])

    return df.mapInArrow(run, T.StructType([df.schema[key], T.StructField("__g", T.LongType())]))


def _anchor_filter(anchors: DataFrame) -> np.ndarray:
    """The words of a bit filter of all anchors: as many whatever their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word, bit = RS.bit_of(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array((np.uint64(1) << bit).view(np.int64))], names=["word", "bits"])

    words = anchors.select("__g").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(1 << RS.FILTER_BITS, np.uint64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return bits


def _rest_join(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """(__key, __c) with the first of any number of rules contained in each text (__key, __lt).

    Of the rules, only the kinds of their anchors (at most 5 numbers) and a bit filter of fixed
    size pass through the driver:
    1. a rule's anchor is, of all its own anchors, the one that the fewest rules share, so
       that rules with a common beginning do not land on one join key;
    2. each text gives its anchors in one pass; those that are certainly no rule's stay behind, and
       an equi-join finds candidate (text, rule) pairs, two short columns;
    3. candidates are confirmed with ``contains`` on the text, joined back by its digest, and
       ``min_by`` over (created_at, id) picks the winner (partial aggregation before the shuffle).
    """
    size = F.octet_length("__p")
    kinds = sorted(r[0] for r in rules.select(F.when(size >= RS.LONG_RULE, 8).otherwise(F.least(size, F.lit(4))).alias("k")).distinct().collect())
    own = _anchors(rules.select("__id", "__p"), "__id", kinds, True).distinct()
    shared = own.groupBy("__g").agg(F.count(F.lit(1)).alias("__n"))
    choice = own.join(shared, "__g").groupBy("__id").agg(F.min_by("__g", F.struct("__n", "__g")).alias("__g"))
    anchored = _written(choice, "rule-anchors")
    found = _anchors(texts, "__key", kinds, False, _anchor_filter(anchored)).join(anchored, "__g").select("__key", "__id").distinct()
    sure = texts.join(found.join(rules, "__id"), "__key").filter(F.col("__lt").contains(F.col("__p")))
    return sure.groupBy("__key").agg(F.min_by("__r", F.struct("__o", "__p")).alias("__c"))


def pii_count(df: DataFrame, text_col: str = "prompt") -> DataFrame:
    return df.withColumn("pii_matches", R.pii_count(F.coalesce(F.col(text_col), F.lit(""))).cast("int"))


def pii_redact(df: DataFrame, text_col: str = "prompt") -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (_redact_once(df.withColumn("__r", R.pii_redact(text)), text)
            .withColumn("pii_matches", F.col("__n").cast("int"))
            .withColumn("redacted", F.col("__r")).drop("__n", "__r"))


def pii_by_type(df: DataFrame, text_col: str = "prompt") -> DataFrame:
    """Matches per PII pattern label over all prompts: label, matches, prompts.

    One regex pass per prompt tags every match with its pattern; the
    aggregation is partial (map-side) over ten labels, so only ten rows per
    task reach the shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    labels = F.array(*[F.lit(lbl) for _, lbl in R.PII_PATTERNS])
    # The generator consumes the counts directly: a filter placed before it
    # would be pushed below the projection and re-run the regex.
    per_row = (df.select(F.inline(F.arrays_zip(labels.alias("label"),
                                                R.pii_pattern_counts(text).alias("n"))))
                 .filter(F.col("n") > 0))
    return per_row.groupBy("label").agg(F.sum("n").cast("long").alias("matches"),
                                        F.count(F.lit(1)).alias("prompts"))


def payload_size_filter(df: DataFrame, text_col: str = "prompt", max_bytes: int = 10240) -> DataFrame:
    """Adds payload_bytes and accepted (UTF-8 size within the limit)."""
    return (df.withColumn("payload_bytes", payload_bytes(F.coalesce(F.col(text_col), F.lit(""))))
              .withColumn("accepted", F.col("payload_bytes") <= F.lit(max_bytes)))


def event_project(scored: DataFrame, *, text_col: str = "prompt", id_col: str = "id",
                  unix_ts_col: str = "unix_ts", latency_col: str = "latency_ms",
                  ip_col: str = "ip_address", ts_col: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Ledger rows from scored prompts (13 columns, and those of ``keep``).

    Blocked rows keep the raw payload but store '' as sanitized payload and 0
    masked tokens; the snippet is the first 80 code points plus '...'; the
    timestamp text is rendered in the session time zone from ``ts_col`` when
    given, else from unix_ts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    blocked = F.col("status") == F.lit(R.STATUS_BLOCKED)
    ts = F.col(ts_col) if ts_col else F.timestamp_seconds(F.col(unix_ts_col))
    return scored.select(
        F.col(id_col).cast("string").alias("id"),
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.col(unix_ts_col).cast("double").alias("unix_ts"),
        F.col("status"),
        F.col("severity"),
        F.round(F.col(latency_col).cast("double"), 2).alias("latency_ms"),
        F.when(blocked, F.lit(0)).otherwise(F.col("tokens_masked")).cast("int").alias("tokens_masked"),
        payload_bytes(text).alias("payload_bytes"),
        F.col("matched_rule"),
        text.alias("full_payload"),
        F.when(blocked, F.lit("")).otherwise(F.col("sanitized_text")).alias("sanitized_payload"),
        F.col(ip_col).cast("string").alias("ip_address"),
        snippet(text).alias("snippet"),
        *keep,
    )


# FIXED VALUES — gateway response texts.
BLOCKED_DETAIL = 'Security Governance Exception: Prompt injection detected — rule: "{rule}"'
RATE_LIMIT_DETAIL = "Rate limit exceeded. Max 100 requests per minute per IP."
MASKED_MESSAGE = "[{status}] {n} credential / PII token(s) redacted. Prompt forwarded to enterprise gateway."
CLEAN_MESSAGE = "Authentication signature accepted. Prompt passed all governance checks — forwarded clean."
ROUTING_TARGET = "Enterprise-Cloud-Foundry"


def gateway_response(ledger: DataFrame, admitted_col: str | None = None) -> DataFrame:
    """HTTP status and response per ledger row: 429 (denied), 400 (blocked) or 200.

    ``body`` is the JSON the gateway returns; ``message`` is its human text.
    """
    blocked = F.col("status") == F.lit(R.STATUS_BLOCKED)
    denied = (~F.col(admitted_col)) if admitted_col else F.lit(False)
    message = (F.when(denied, F.lit(RATE_LIMIT_DETAIL))
                .when(blocked, F.concat(F.lit(BLOCKED_DETAIL.split("{rule}")[0]), F.col("matched_rule"),
                                        F.lit(BLOCKED_DETAIL.split("{rule}")[1])))
                .when(F.col("tokens_masked") > 0,
                      F.concat(F.lit("["), F.col("status"), F.lit("] "), F.col("tokens_masked").cast("string"),
                               F.lit(MASKED_MESSAGE.split("{n}")[1])))
                .otherwise(F.lit(CLEAN_MESSAGE)))
    http_status = F.when(denied, F.lit(429)).when(blocked, F.lit(400)).otherwise(F.lit(200))
    ok_body = F.to_json(F.struct(
        F.col("status"), F.col("id").alias("event_id"), F.col("severity"),
        F.col("sanitized_payload").alias("processed_prompt"),
        F.struct(F.col("latency_ms"), F.col("tokens_masked"),
                 F.lit(ROUTING_TARGET).alias("routing_target")).alias("telemetry"),
        message.alias("response")))
    err_body = F.to_json(F.struct(message.alias("detail")))
    return ledger.select("id", http_status.alias("http_status"), message.alias("message"),
                         F.when(http_status == 200, ok_body).otherwise(err_body).alias("body"))
