"""Every operator of the inventory as a query over the test tables, with its DuckDB oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLE[name] -> SQL``.
Each query reads whole tables (documents, events, benchmark) or data Spark
derives from them; parameters (``now``, limits, search strings, rate limits)
are fixed here so both sides compute the same thing.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptlens.functions import rules as R
from promptlens.operators import gateway as GW
from promptlens.operators import ledger as L
from promptlens.operators import ratelimit as RL
from promptlens.operators import reports as E
from promptlens.operators import scoring as S
from promptlens.operators import tables as G
from promptlens.plans import oracle as O
from promptlens.plans import testdata as TD
from promptlens.schemas import LEDGER, LEDGER_COLUMNS
from promptlens.session import scratch_path
from promptlens.sources import audit_log as AL
from promptlens.sources import exports as X
from promptlens.sources import ledger_io as IO
from promptlens.sources import prompts as P
from promptlens.streaming import streams as H

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

NOW = TD.NOW_UNIX
# Rate-limit parameters for the test data (the defaults 100 / 60 s deny nothing there).
RL_LIMIT, RL_WINDOW = 3, 21600.0
SEARCH_LIKE = "USER2_@EXAMPLE.COM"
SEARCH_LITERAL, SEARCH_LITERAL_STATUS = "bearer", "SANITIZED"
QUERY_STATUS, QUERY_SEARCH, QUERY_LIMIT = "BLOCKED", "override", 100
LOOKUP_ID = "ev-000000042"
BENCH_RULE_SEVERITY, BENCH_RULE_CREATED = "HIGH", "2024-01-01 00:00:00"


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _cols(cols):
    return ", ".join(f'"{c}"' if c == "timestamp" else c for c in cols)


LCOLS = _cols(LEDGER_COLUMNS)


def ledger(spark, sf):
    return TD.ledger(spark, sf)


# ---------------------------------------------------------------------------
# B. Text scoring
# ---------------------------------------------------------------------------
SCORE_COLS = ["doc_id", "status", "severity", "matched_rule", "tokens_masked", "sanitized_text"]


@query("score_prompts", O.with_scored(f"SELECT {_cols(SCORE_COLS)} FROM scored"))
def q_score(spark, sf):
    return TD.scored_prompts(spark, sf).select(*SCORE_COLS)


@query("injection_scan", O.with_scored("""SELECT doc_id, inj_rank IS NOT NULL AS blocked,
  CASE WHEN inj_rank IS NOT NULL THEN severity END AS severity,
  CASE WHEN inj_rank IS NOT NULL THEN matched_rule END AS matched_rule
FROM (SELECT s.*, i.inj_rank FROM scored s JOIN inj i USING (doc_id))"""))
def q_inj(spark, sf):
    return S.injection_scan(TD.prompts(spark, sf)).select("doc_id", "blocked", "severity", "matched_rule")


_TERMS_SQL = " UNION ALL ".join(
    f"SELECT {i} AS term_rank, {O.q(t)} AS term, {O.q(s)} AS severity, {O.q(r)} AS matched_rule"
    for i, (t, s, r) in enumerate(R.INJECTION_RULES, start=1))


@query("injection_all_hits", f"""WITH {O.prompts_cte()}, terms AS ({_TERMS_SQL})
SELECT p.doc_id, t.term_rank, t.term, t.severity, t.matched_rule
FROM prompts p JOIN terms t ON contains(lower(p.prompt), t.term)""")
def q_inj_all(spark, sf):
    return S.injection_all_hits(TD.prompts(spark, sf))


def _benchmark_rules(spark, sf) -> DataFrame:
    """Custom rules from the benchmark passages: block prompts quoting one."""
    b = TD.table(spark, sf, "benchmark")
    return b.select(F.concat(F.lit("bm-"), F.lpad(F.col("item_id").cast("string"), 6, "0")).alias("id"),
                    F.concat(F.lit("Benchmark passage "), F.col("item_id").cast("string")).alias("name"),
                    F.col("text").alias("pattern"), F.lit(BENCH_RULE_SEVERITY).alias("severity"),
                    F.lit(True).alias("enabled"), F.lit(BENCH_RULE_CREATED).alias("created_at"))


def _document_rules(spark, sf) -> DataFrame:
    """A custom rule from each document: 4 to 43 characters of it."""
    i = F.col("doc_id")
    return TD.table(spark, sf, "documents").select(
        F.concat(F.lit("doc-"), F.lpad(i.cast("string"), 9, "0")).alias("id"),
        F.concat(F.lit("Words of document "), i.cast("string")).alias("name"),
        F.substring(F.coalesce("text", F.lit("")), (i * 7 % 97 + 1).cast("int"), (i % 40 + 4).cast("int")).alias("pattern"),
        F.lit(BENCH_RULE_SEVERITY).alias("severity"), F.lit(True).alias("enabled"),
        F.concat(F.lit("2024-01-"), F.lpad((i % 28 + 1).cast("string"), 2, "0")).alias("created_at"))


_BENCH_RULES_SQL = """SELECT 'bm-' || lpad(CAST(item_id AS VARCHAR), 6, '0') AS id,
     'Benchmark passage ' || CAST(item_id AS VARCHAR) AS name, text AS pattern, '' AS created_at FROM benchmark"""
_DOCUMENT_RULES_SQL = """SELECT 'doc-' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS id,
     'Words of document ' || CAST(doc_id AS VARCHAR) AS name,
     substr(coalesce(text, ''), doc_id * 7 % 97 + 1, doc_id % 40 + 4) AS pattern,
     '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') AS created_at FROM documents"""


def _policy_sql(rules: str) -> str:
    return O.with_scored(f"""
, rules AS (SELECT * FROM ({rules}) WHERE length(pattern) > 0),
ranked AS (SELECT *, row_number() OVER (ORDER BY created_at, id) AS rk FROM rules),
hit AS (SELECT p.doc_id, arg_min(r.name, r.rk) AS rule_name
        FROM prompts p JOIN ranked r ON contains(lower(p.prompt), lower(r.pattern)) GROUP BY p.doc_id),
custom AS (SELECT c.doc_id, c.prompt, c.inj_rank, h.rule_name FROM inj c LEFT JOIN hit h USING (doc_id)),
cnt2 AS (SELECT *, CASE WHEN inj_rank IS NULL AND rule_name IS NULL THEN {O.pii_count_sql('prompt')} ELSE 0 END AS n
         FROM custom)
SELECT doc_id,
  CASE WHEN inj_rank IS NOT NULL OR rule_name IS NOT NULL THEN 'BLOCKED' WHEN n > 0 THEN 'SANITIZED'
       ELSE 'PASSED' END AS status,
  CASE WHEN inj_rank IS NOT NULL THEN {O.rank_to(1)} WHEN rule_name IS NOT NULL THEN '{BENCH_RULE_SEVERITY}'
       WHEN n > 0 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN inj_rank IS NOT NULL THEN {O.rank_to(2)} WHEN rule_name IS NOT NULL THEN rule_name
       WHEN n > 0 THEN {O.q(R.PII_RULE_LABEL)} END AS matched_rule,
  CAST(n AS INTEGER) AS tokens_masked
FROM cnt2""").replace("FROM cnt)\n\n,", "FROM cnt)\n,")


def _rules_applied(spark, sf, rules: DataFrame) -> DataFrame:
    scored = S.score_prompts(TD.prompts(spark, sf), "prompt", custom_rules=S.load_policy_rules(rules))
    return scored.select("doc_id", "status", "severity", "matched_rule", "tokens_masked")


@query("policy_rule_scan", _policy_sql(_BENCH_RULES_SQL))
def q_policy_scan(spark, sf):
    return _rules_applied(spark, sf, _benchmark_rules(spark, sf))


@query("policy_rule_scan_many", _policy_sql(_DOCUMENT_RULES_SQL))
def q_policy_scan_many(spark, sf):
    return _rules_applied(spark, sf, _document_rules(spark, sf))


@query("pii_count", f"WITH {O.prompts_cte()} SELECT doc_id, CAST({O.pii_count_sql('prompt')} AS INTEGER) "
                    "AS pii_matches FROM prompts")
def q_pii_count(spark, sf):
    return S.pii_count(TD.prompts(spark, sf)).select("doc_id", "pii_matches")


@query("pii_redact", f"""WITH {O.prompts_cte()},
c AS (SELECT doc_id, prompt, CAST({O.pii_count_sql('prompt')} AS INTEGER) AS pii_matches FROM prompts)
SELECT doc_id, pii_matches, CASE WHEN pii_matches > 0 THEN {O.pii_redact_sql('prompt')} ELSE prompt END AS redacted
FROM c""")
def q_pii_redact(spark, sf):
    return S.pii_redact(TD.prompts(spark, sf)).select("doc_id", "pii_matches", "redacted")


_LABELS_SQL = " UNION ALL ".join(f"SELECT {g} AS g, {O.q(lbl)} AS label"
                                 for g, (_, lbl) in enumerate(R.PII_PATTERNS, start=1))
_GROUP_COUNTS = ", ".join(
    f"len(list_filter(regexp_extract_all(prompt, {O.PII_ALT_SQL}, {g}, 'i'), lambda x: x <> '')) AS g{g}"
    for g in range(1, len(R.PII_PATTERNS) + 1))
_UNPIVOT = " UNION ALL ".join(f"SELECT {g} AS g, g{g} AS n FROM per_doc" for g in range(1, len(R.PII_PATTERNS) + 1))


@query("pii_by_type", f"""WITH {O.prompts_cte()}, labels AS ({_LABELS_SQL}),
per_doc AS (SELECT {_GROUP_COUNTS} FROM prompts),
per AS ({_UNPIVOT})
SELECT l.label, CAST(sum(p.n) AS BIGINT) AS matches, count(*) AS prompts
FROM per p JOIN labels l USING (g) WHERE p.n > 0 GROUP BY l.label""")
def q_pii_by_type(spark, sf):
    return S.pii_by_type(TD.prompts(spark, sf))


@query("event_project", O.with_ledger(f"SELECT {LCOLS} FROM ledger"))
def q_event_project(spark, sf):
    return ledger(spark, sf)


@query("detection_toggles", O.with_scored(
    "SELECT doc_id, status, severity, matched_rule, tokens_masked FROM scored", enable_injection=False))
def q_toggles(spark, sf):
    return (TD.scored_prompts(spark, sf, enable_injection=False)
            .select("doc_id", "status", "severity", "matched_rule", "tokens_masked"))


@query("payload_size_filter", f"WITH {O.prompts_cte()} SELECT doc_id, CAST(strlen(prompt) AS INTEGER) "
                              "AS payload_bytes, strlen(prompt) <= 10240 AS accepted FROM prompts")
def q_size(spark, sf):
    return S.payload_size_filter(TD.prompts(spark, sf), max_bytes=10240).select("doc_id", "payload_bytes",
                                                                                  "accepted")


# ---------------------------------------------------------------------------
# C. Rate limiting
# ---------------------------------------------------------------------------
def _rl_ctes(limit=RL_LIMIT, window=RL_WINDOW) -> str:
    kept = f"list_filter(r.hits, lambda t: q.unix_ts - t < {window})"
    return f"""req AS (SELECT id, ip_address, unix_ts,
    row_number() OVER (PARTITION BY ip_address ORDER BY unix_ts, id) AS rn FROM requests),
rl(ip_address, rn, id, hits, admitted) AS (
  SELECT ip_address, rn, id, [unix_ts], true FROM req WHERE rn = 1
  UNION ALL
  SELECT q.ip_address, q.rn, q.id,
    CASE WHEN len({kept}) >= {limit} THEN {kept} ELSE list_append({kept}, q.unix_ts) END,
    len({kept}) < {limit}
  FROM rl r JOIN req q ON q.ip_address IS NOT DISTINCT FROM r.ip_address AND q.rn = r.rn + 1)"""


def _with_rl(body: str) -> str:
    return f"WITH RECURSIVE {O.requests_cte()},\n{_rl_ctes()}\n{body}"


def _admitted(spark, sf) -> DataFrame:
    return RL.rate_limit_admit(TD.requests(spark, sf), "ip_address", "unix_ts", "id", RL_LIMIT, RL_WINDOW)


@query("rate_limit_admit", _with_rl("""SELECT q.id, q.ip_address, q.unix_ts, rl.admitted
FROM requests q JOIN rl USING (id)"""))
def q_rl(spark, sf):
    return _admitted(spark, sf).select("id", "ip_address", "unix_ts", "admitted")


@query("rate_limit_denials", _with_rl("""SELECT ip_address, count(*) AS requests,
  count(*) FILTER (WHERE NOT admitted) AS denied FROM rl GROUP BY ip_address"""))
def q_rl_denials(spark, sf):
    return RL.rate_limit_denials(_admitted(spark, sf))


_GATEWAY_SQL = ("WITH RECURSIVE " + O.with_ledger("").replace("WITH ", "", 1).rstrip() + ",\n" + _rl_ctes() + f"""
SELECT l.id, CASE WHEN NOT rl.admitted THEN 429 WHEN l.status = 'BLOCKED' THEN 400 ELSE 200 END AS http_status,
  CASE WHEN NOT rl.admitted THEN {O.q(S.RATE_LIMIT_DETAIL)}
       WHEN l.status = 'BLOCKED' THEN {O.q(S.BLOCKED_DETAIL.split('{rule}')[0])} || l.matched_rule
            || {O.q(S.BLOCKED_DETAIL.split('{rule}')[1])}
       WHEN l.tokens_masked > 0 THEN '[' || l.status || '] ' || CAST(l.tokens_masked AS VARCHAR)
            || {O.q(S.MASKED_MESSAGE.split('{n}')[1])}
       ELSE {O.q(S.CLEAN_MESSAGE)} END AS message,
  CASE WHEN http_status <> 200 THEN '{{"detail":' || CAST(to_json(message) AS VARCHAR) || '}}'
       ELSE '{{"status":"' || l.status || '","event_id":"' || l.id || '","severity":"' || l.severity || '","processed_prompt":'
            || CAST(to_json(l.sanitized_payload) AS VARCHAR) || ',"telemetry":{{"latency_ms":' || CAST(l.latency_ms AS VARCHAR)
            || ',"tokens_masked":' || CAST(l.tokens_masked AS VARCHAR) || ',"routing_target":"{S.ROUTING_TARGET}"}},"response":'
            || CAST(to_json(message) AS VARCHAR) || '}}' END AS body
FROM ledger l JOIN rl USING (id)""")


@query("gateway_response", _GATEWAY_SQL)
def q_gateway(spark, sf):
    decisions = RL.rate_limit_decisions(TD.requests(spark, sf), "ip_address", "unix_ts", "id", RL_LIMIT, RL_WINDOW)
    return S.gateway_response(TD.ledger(spark, sf, decisions), "admitted")


def _gateway_changes(spark, sf) -> DataFrame:
    """A change of a setting with every 500th event: both switches, and the payload limit, in turn."""
    i = F.col("event_id") / 500
    turn = F.floor(i).cast("long")
    return TD.table(spark, sf, "events").filter("event_id % 500 = 0").select(
        (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000.0)).alias("unix_ts"), F.col("event_id").alias("seq"),
        F.when(turn % 3 == 0, "enable_pii_detection").when(turn % 3 == 1, "enable_injection_detection").otherwise("max_payload_size").alias("key"),
        F.when(turn % 3 == 2, ((turn % 5 + 1) * 1000).cast("string")).when(turn % 2 == 0, "False").otherwise("true").alias("value"))


_GATEWAY_PIPELINE_SQL = ("WITH RECURSIVE " + O.with_ledger("").replace("WITH ", "", 1).rstrip() + ",\n" + _rl_ctes() + f""",
turns AS (SELECT epoch_us(ts) / 1000000.0 AS since, event_id AS seq, event_id // 500 AS turn FROM events WHERE event_id % 500 = 0),
chg AS (SELECT since, seq, turn % 3 AS k, CASE WHEN turn % 3 = 2 THEN (turn % 5 + 1) * 1000 WHEN turn % 2 = 0 THEN 0 ELSE 1 END AS v FROM turns),
pii AS (SELECT since, arg_max(v, seq) AS v FROM chg WHERE k = 0 GROUP BY since),
injd AS (SELECT since, arg_max(v, seq) AS v FROM chg WHERE k = 1 GROUP BY since),
siz AS (SELECT since, arg_max(v, seq) AS v FROM chg WHERE k = 2 GROUP BY since),
r AS (SELECT q.id, q.unix_ts, q.doc_id, rl.admitted, coalesce(pii.v, 1) = 1 AS pii_on, coalesce(injd.v, 1) = 1 AS inj_on, coalesce(siz.v, 10240) AS most
  FROM requests q JOIN rl USING (id) ASOF LEFT JOIN pii ON q.unix_ts >= pii.since ASOF LEFT JOIN injd ON q.unix_ts >= injd.since ASOF LEFT JOIN siz ON q.unix_ts >= siz.since),
texts AS (SELECT doc_id, prompt, inj_rank, {O.pii_count_sql('prompt')} AS n FROM inj),
o AS (SELECT r.id, CASE WHEN NOT admitted THEN 'DENIED' WHEN strlen(prompt) > most THEN 'TOO_LARGE' ELSE 'SCORED' END AS outcome,
    CASE WHEN inj_on THEN inj_rank END AS inj_rank, CASE WHEN inj_on AND inj_rank IS NOT NULL OR NOT pii_on THEN 0 ELSE n END AS n FROM r JOIN texts USING (doc_id))
SELECT id, outcome, CASE WHEN outcome <> 'SCORED' THEN NULL WHEN inj_rank IS NOT NULL THEN 'BLOCKED' WHEN n > 0 THEN 'SANITIZED' ELSE 'PASSED' END AS status,
  CASE WHEN outcome <> 'SCORED' THEN NULL WHEN inj_rank IS NOT NULL THEN {O.rank_to(1)} WHEN n > 0 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN outcome <> 'SCORED' THEN NULL WHEN inj_rank IS NOT NULL THEN {O.rank_to(2)} WHEN n > 0 THEN {O.q(R.PII_RULE_LABEL)} END AS matched_rule,
  CASE WHEN outcome = 'SCORED' THEN CAST(n AS INTEGER) END AS tokens_masked FROM o""")


@query("gateway_pipeline", _GATEWAY_PIPELINE_SQL)
def q_gateway_pipeline(spark, sf):
    requests = TD.requests(spark, sf).join(TD.prompts(spark, sf), "doc_id")
    return GW.gateway(requests, _gateway_changes(spark, sf), limit=RL_LIMIT, window=RL_WINDOW).select("id", "outcome", "status", "severity", "matched_rule", "tokens_masked")


# ---------------------------------------------------------------------------
# D. Ledger filters and listings
# ---------------------------------------------------------------------------
def _lower_ascii_sql(c: str) -> str:
    return f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _like_sql(search: str) -> str:
    pat = O.q("%" + search.lower() + "%")
    return f"({_lower_ascii_sql('snippet')} LIKE {pat} OR {_lower_ascii_sql('full_payload')} LIKE {pat})"


@query("ledger_by_status", O.with_ledger(f"SELECT {LCOLS} FROM ledger WHERE status = 'SANITIZED'"))
def q_by_status(spark, sf):
    return L.ledger_by_status(ledger(spark, sf), "SANITIZED")


@query("ledger_search", O.with_ledger(f"SELECT {LCOLS} FROM ledger WHERE {_like_sql(SEARCH_LIKE)}"))
def q_search(spark, sf):
    return L.ledger_search(ledger(spark, sf), SEARCH_LIKE)


@query("ledger_search_literal", O.with_ledger(
    f"SELECT {LCOLS} FROM ledger WHERE status = '{SEARCH_LITERAL_STATUS}' AND "
    f"(contains(lower(full_payload), '{SEARCH_LITERAL}') OR contains(lower(snippet), '{SEARCH_LITERAL}'))"))
def q_search_lit(spark, sf):
    return L.ledger_search_literal(ledger(spark, sf), SEARCH_LITERAL, SEARCH_LITERAL_STATUS)


@query("ledger_recent", O.with_ledger(f"SELECT {LCOLS} FROM ledger ORDER BY unix_ts DESC, id LIMIT 50"))
def q_recent(spark, sf):
    return L.ledger_recent(ledger(spark, sf), 50)


@query("ledger_query", O.with_ledger(
    f"SELECT {LCOLS} FROM ledger WHERE status = '{QUERY_STATUS}' AND {_like_sql(QUERY_SEARCH)} "
    f"ORDER BY unix_ts DESC, id LIMIT {QUERY_LIMIT}"))
def q_query(spark, sf):
    return L.ledger_query(ledger(spark, sf), QUERY_LIMIT, QUERY_STATUS, QUERY_SEARCH)


@query("event_lookup", O.with_ledger(f"SELECT {LCOLS} FROM ledger WHERE id = '{LOOKUP_ID}'"))
def q_lookup(spark, sf):
    return L.event_lookup(ledger(spark, sf), LOOKUP_ID)


@query("sanitized_diff", O.with_ledger("""SELECT id, full_payload, sanitized_payload,
  CAST(len(regexp_extract_all(sanitized_payload, '\\[REDACTED\\]')) AS INTEGER) AS redaction_marks
FROM ledger WHERE sanitized_payload <> '' AND sanitized_payload <> full_payload"""))
def q_diff(spark, sf):
    return L.sanitized_diff(ledger(spark, sf))


@query("ledger_view", O.with_ledger("""SELECT id, "timestamp", status, coalesce(severity, '—') AS severity,
  latency_ms, tokens_masked, payload_bytes, matched_rule,
  CASE WHEN length(full_payload) > 70 THEN substr(full_payload, 1, 70) || '…' ELSE full_payload END AS payload_view,
  length(full_payload) > 70 AS has_more FROM ledger"""))
def q_view(spark, sf):
    return L.ledger_view(ledger(spark, sf))


# ---------------------------------------------------------------------------
# G. Rule and settings tables from change logs derived from ``events``
# ---------------------------------------------------------------------------
RULE_IDS = 37


def _rule_changes(spark, sf) -> DataFrame:
    ev = TD.table(spark, sf, "events")
    op = (F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete")
          .otherwise("update"))
    sev = (F.when(F.col("value") < 10, "LOW").when(F.col("value") < 25, "MEDIUM")
           .when(F.col("value") < 40, "HIGH").otherwise("CRITICAL"))
    return ev.select(F.col("event_id").alias("seq"), op.alias("op"),
                     F.concat(F.lit("rule-"), F.pmod("user_id", F.lit(RULE_IDS)).cast("string")).alias("id"),
                     F.concat(F.lit("rule "), F.col("event_type"), F.lit(" "), F.col("event_id").cast("string"))
                      .alias("name"),
                     F.col("props").alias("pattern"), sev.alias("severity"),
                     F.when(F.col("event_type") == "view", F.lit(None).cast("boolean"))
                      .otherwise(F.col("value") >= 5).alias("enabled"),
                     F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("ts"))


_RULE_CHANGES_SQL = f"""changes AS (SELECT event_id AS seq,
  CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op,
  'rule-' || CAST(user_id % {RULE_IDS} AS VARCHAR) AS id,
  'rule ' || event_type || ' ' || CAST(event_id AS VARCHAR) AS name, props AS pattern,
  CASE WHEN value < 10 THEN 'LOW' WHEN value < 25 THEN 'MEDIUM' WHEN value < 40 THEN 'HIGH' ELSE 'CRITICAL' END
    AS severity,
  coalesce(CASE WHEN event_type = 'view' THEN NULL ELSE value >= 5 END, true) AS enabled,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events)"""

# Oracle: replay per id with window functions (an independent formulation).
_RULES_TABLE_SQL = f"""{_RULE_CHANGES_SQL},
marked AS (SELECT *, max(CASE WHEN op = 'delete' THEN seq END) OVER (PARTITION BY id) AS last_del FROM changes),
alive AS (SELECT * FROM marked WHERE op <> 'delete' AND (last_del IS NULL OR seq > last_del)),
ins AS (SELECT id, seq AS ins_seq, name, pattern, severity, enabled, ts AS created_at FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS k FROM alive WHERE op = 'insert') WHERE k = 1),
upd AS (SELECT a.id, a.name, a.pattern, a.severity, a.enabled, row_number() OVER (PARTITION BY a.id ORDER BY a.seq DESC)
        AS k FROM alive a JOIN ins i ON a.id = i.id AND a.op = 'update' AND a.seq > i.ins_seq),
rules AS (SELECT i.id, coalesce(u.name, i.name) AS name, coalesce(u.pattern, i.pattern) AS pattern,
  coalesce(u.severity, i.severity) AS severity, CASE WHEN u.id IS NULL THEN i.enabled ELSE u.enabled END AS enabled,
  i.created_at FROM ins i LEFT JOIN (SELECT * FROM upd WHERE k = 1) u ON u.id = i.id)"""


def _rules(spark, sf) -> DataFrame:
    return G.policy_rules_apply(_rule_changes(spark, sf))


@query("policy_rules_apply", f"WITH {_RULES_TABLE_SQL} SELECT id, name, pattern, severity, enabled, created_at "
                             "FROM rules")
def q_rules_apply(spark, sf):
    return _rules(spark, sf)


@query("policy_rules_list", f"WITH {_RULES_TABLE_SQL} SELECT id, name, pattern, severity, enabled, created_at "
                            "FROM rules ORDER BY created_at DESC, id")
def q_rules_list(spark, sf):
    return L.policy_rules_list(_rules(spark, sf))


# FIXED VALUES — which setting each event type writes in the derived change log.
SETTING_OF_EVENT = [("signup", "rate_limit"), ("click", "rate_window"), ("view", "max_payload_size"),
                    ("purchase", "alert_email"), ("error", "webhook_url")]


def _settings_changes(spark, sf) -> DataFrame:
    ev = TD.table(spark, sf, "events")
    key = None
    for et, k in SETTING_OF_EVENT:
        key = F.when(F.col("event_type") == et, k) if key is None else key.when(F.col("event_type") == et, k)
    return ev.select(F.col("event_id").alias("seq"), key.otherwise(F.col("event_type")).alias("key"),
                     F.col("props").alias("value"))


_SETTINGS_SQL = "settings_changes AS (SELECT event_id AS seq, CASE event_type " + " ".join(
    f"WHEN '{et}' THEN '{k}'" for et, k in SETTING_OF_EVENT) + " ELSE event_type END AS key, props AS value FROM events)"
_DEFAULTS_SQL = "defaults AS (" + " UNION ALL ".join(
    f"SELECT {O.q(k)} AS key, {O.q(v)} AS value" for k, v in G.DEFAULT_SETTINGS) + ")"
_UPSERTED_SQL = f"""{_SETTINGS_SQL}, {_DEFAULTS_SQL},
upserted AS (SELECT key, arg_max(value, seq) AS value FROM (
  SELECT -1 AS seq, key, value FROM defaults UNION ALL SELECT seq, key, value FROM settings_changes) GROUP BY key)"""


def _defaults_df(spark):
    return spark.createDataFrame(G.DEFAULT_SETTINGS, "key string, value string")


@query("settings_upsert", f"WITH {_UPSERTED_SQL} SELECT key, value FROM upserted")
def q_settings_upsert(spark, sf):
    return G.settings_upsert(_defaults_df(spark), _settings_changes(spark, sf))


@query("settings_defaults", f"""WITH {_SETTINGS_SQL}, {_DEFAULTS_SQL},
cur AS (SELECT key, arg_max(value, seq) AS value FROM settings_changes GROUP BY key)
SELECT key, value FROM cur UNION ALL SELECT key, value FROM defaults WHERE key NOT IN (SELECT key FROM cur)""")
def q_settings_defaults(spark, sf):
    empty = spark.createDataFrame([], "key string, value string")
    current = G.settings_upsert(empty, _settings_changes(spark, sf))
    return G.settings_defaults(current)


@query("settings_map", f"""WITH {_UPSERTED_SQL}
SELECT '{{' || string_agg(to_json(key) || ':' || to_json(value), ',' ORDER BY key) || '}}' AS settings_json
FROM upserted""")
def q_settings_map(spark, sf):
    m = G.settings_map(G.settings_upsert(_defaults_df(spark), _settings_changes(spark, sf)))
    return m.select(F.to_json("settings").alias("settings_json"))


# ---------------------------------------------------------------------------
# E. Reports (now = 2024-01-31 00:30:00 UTC)
# ---------------------------------------------------------------------------
def _since_sql(span: int) -> str:
    return f"unix_ts > {NOW - span}"


@query("counters_total", O.with_ledger("""SELECT count(*) AS total_processed,
  count(*) FILTER (WHERE status = 'BLOCKED') AS total_blocked,
  count(*) FILTER (WHERE status = 'SANITIZED') AS total_sanitized,
  count(*) FILTER (WHERE status = 'PASSED') AS total_passed FROM ledger"""))
def q_counters(spark, sf):
    return E.counters_total(ledger(spark, sf))


_CHART_SQL = f"""chart AS (SELECT substr("timestamp", 12, 2) || ':00' AS hour, status, count(*) AS count
FROM ledger WHERE {_since_sql(E.DAY_S)} GROUP BY 1, 2)"""


@query("chart_24h", O.with_ledger(f", {_CHART_SQL} SELECT hour, status, count FROM chart"
                                  ).replace("FROM requests r JOIN scored s ON r.doc_id = s.doc_id)\n,",
                                            "FROM requests r JOIN scored s ON r.doc_id = s.doc_id),"))
def q_chart(spark, sf):
    return E.chart_24h(ledger(spark, sf), NOW)


_DENSE_SQL = O.with_ledger(f""", {_CHART_SQL},
labels AS (SELECT CAST(i AS INTEGER) AS slot,
  strftime(make_timestamp(CAST(({NOW} - (11 - i) * 3600) * 1000000 AS BIGINT)), '%H') || ':00' AS hour
  FROM range(12) t(i)),
dense AS (SELECT l.slot, l.hour,
  CAST(coalesce(sum(c.count) FILTER (WHERE c.status = 'BLOCKED'), 0) AS BIGINT) AS blocked,
  CAST(coalesce(sum(c.count) FILTER (WHERE c.status = 'SANITIZED'), 0) AS BIGINT) AS sanitized,
  CAST(coalesce(sum(c.count) FILTER (WHERE c.status = 'PASSED'), 0) AS BIGINT) AS passed
  FROM labels l LEFT JOIN chart c ON c.hour = l.hour GROUP BY l.slot, l.hour)
SELECT slot, hour, blocked, sanitized, passed, blocked + sanitized + passed AS total,
  CAST(greatest(1, max(blocked + sanitized + passed) OVER ()) AS BIGINT) AS scale FROM dense""").replace(
    "FROM requests r JOIN scored s ON r.doc_id = s.doc_id)\n,", "FROM requests r JOIN scored s ON r.doc_id = s.doc_id),")


@query("chart_dense_12h", _DENSE_SQL)
def q_dense(spark, sf):
    return E.chart_dense_12h(ledger(spark, sf), NOW)


_SEV_RANK_SQL = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in R.SEVERITY_RANK.items()) + \
    " ELSE 0 END"


@query("top_patterns", O.with_ledger(f"""SELECT matched_rule, count(*) AS count,
  arg_max(severity, {_SEV_RANK_SQL}) AS severity
FROM ledger WHERE status = 'BLOCKED' AND matched_rule IS NOT NULL GROUP BY matched_rule
ORDER BY count DESC, matched_rule LIMIT 10"""))
def q_top_patterns(spark, sf):
    return E.top_patterns(ledger(spark, sf))


@query("attack_sources", O.with_ledger("""SELECT ip_address, count(*) AS count FROM ledger
WHERE status = 'BLOCKED' GROUP BY ip_address ORDER BY count DESC, ip_address ASC NULLS FIRST LIMIT 10"""))
def q_sources(spark, sf):
    return E.attack_sources(ledger(spark, sf))


@query("severity_distribution", O.with_ledger(
    "SELECT severity, count(*) AS count FROM ledger WHERE status = 'BLOCKED' GROUP BY severity"))
def q_sev(spark, sf):
    return E.severity_distribution(ledger(spark, sf))


_RECENT_SQL = f"""SELECT matched_rule, severity, count(*) AS count FROM ledger
WHERE status = 'BLOCKED' AND {_since_sql(E.DAY_S)} GROUP BY matched_rule, severity
ORDER BY count DESC, matched_rule ASC NULLS FIRST, severity LIMIT 5"""


@query("recent_threats_24h", O.with_ledger(_RECENT_SQL))
def q_recent_threats(spark, sf):
    return E.recent_threats_24h(ledger(spark, sf), NOW)


@query("threat_report", O.with_ledger(f"""
SELECT * FROM (SELECT 'top_patterns' AS section, matched_rule, CAST(NULL AS VARCHAR) AS ip_address,
  arg_max(severity, {_SEV_RANK_SQL}) AS severity, count(*) AS count FROM ledger
  WHERE status = 'BLOCKED' AND matched_rule IS NOT NULL GROUP BY matched_rule
  ORDER BY count DESC, matched_rule LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'attack_sources', NULL, ip_address, NULL, count(*) AS count FROM ledger
  WHERE status = 'BLOCKED' GROUP BY ip_address ORDER BY count DESC, ip_address ASC NULLS FIRST LIMIT 10)
UNION ALL SELECT 'severity_distribution', NULL, NULL, severity, count(*) FROM ledger WHERE status = 'BLOCKED'
  GROUP BY severity
UNION ALL SELECT * FROM (SELECT 'recent_threats_24h', matched_rule, NULL, severity, count(*) AS count FROM ledger
  WHERE status = 'BLOCKED' AND {_since_sql(E.DAY_S)} GROUP BY matched_rule, severity
  ORDER BY count DESC, matched_rule ASC NULLS FIRST, severity LIMIT 5)"""))
def q_threat(spark, sf):
    return E.threat_report(ledger(spark, sf), NOW)


def _avg4_sql(units: str, n: str, per: int) -> str:
    return f"CASE WHEN {n} > 0 THEN CAST((2 * {per} * {units} + {n}) // (2 * {n}) AS DOUBLE) / 10000.0 END"


_AVG_LAT = _avg4_sql("sum(CAST(round(latency_ms * 100) AS BIGINT))", "count(latency_ms)", 100)
_AVG_BYTES = _avg4_sql("sum(payload_bytes)", "count(payload_bytes)", 10000)


_HOURLY_SQL = f"""SELECT substr("timestamp", 1, 13) || ':00' AS hour, status, count(*) AS count,
  {_AVG_LAT} AS avg_latency FROM ledger WHERE {_since_sql(E.WEEK_S)} GROUP BY 1, 2"""
_DAILY_SQL = f"""SELECT substr("timestamp", 1, 10) AS day, count(*) AS total,
  count(*) FILTER (WHERE status = 'BLOCKED') AS blocked, count(*) FILTER (WHERE status = 'SANITIZED') AS sanitized,
  {_AVG_LAT} AS avg_latency FROM ledger WHERE {_since_sql(E.MONTH_S)}
  GROUP BY 1 ORDER BY day DESC LIMIT 30"""
_PERF_SQL = f"""SELECT {_AVG_LAT} AS avg_latency, min(latency_ms) AS min_latency,
  max(latency_ms) AS max_latency, {_AVG_BYTES} AS avg_payload_size FROM ledger"""
_PII_SQL = """SELECT CAST(sum(tokens_masked) AS BIGINT) AS total_tokens_masked,
  count(*) FILTER (WHERE tokens_masked > 0) AS events_with_pii FROM ledger"""


@query("hourly_stats_7d", O.with_ledger(_HOURLY_SQL))
def q_hourly(spark, sf):
    return E.hourly_stats_7d(ledger(spark, sf), NOW)


@query("daily_stats_30d", O.with_ledger(_DAILY_SQL))
def q_daily(spark, sf):
    return E.daily_stats_30d(ledger(spark, sf), NOW)


@query("performance_summary", O.with_ledger(_PERF_SQL))
def q_perf(spark, sf):
    return E.performance_summary(ledger(spark, sf))


@query("pii_summary", O.with_ledger(_PII_SQL))
def q_pii_summary(spark, sf):
    return E.pii_summary(ledger(spark, sf))


@query("analytics_report", O.with_ledger(f"""
SELECT 'hourly_stats' AS section, hour, NULL AS day, status, count, NULL AS blocked, NULL AS sanitized,
  avg_latency, NULL AS min_latency, NULL AS max_latency, NULL AS avg_payload_size,
  NULL AS total_tokens_masked, NULL AS events_with_pii FROM ({_HOURLY_SQL})
UNION ALL SELECT 'daily_stats', NULL, day, NULL, total, blocked, sanitized, avg_latency, NULL, NULL, NULL, NULL, NULL
  FROM ({_DAILY_SQL})
UNION ALL SELECT 'performance', NULL, NULL, NULL, NULL, NULL, NULL, avg_latency, min_latency, max_latency,
  avg_payload_size, NULL, NULL FROM ({_PERF_SQL})
UNION ALL SELECT 'pii_detection', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL,
  total_tokens_masked, events_with_pii FROM ({_PII_SQL})"""))
def q_analytics(spark, sf):
    return E.analytics_report(ledger(spark, sf), NOW)


# ---------------------------------------------------------------------------
# F. Retention
# ---------------------------------------------------------------------------
@query("prune_max_events", O.with_ledger(f"SELECT {LCOLS} FROM ledger ORDER BY unix_ts DESC, id LIMIT 500"))
def q_prune(spark, sf):
    return L.prune_max_events(ledger(spark, sf), 500)


@query("prune_expired", O.with_ledger(f"SELECT {LCOLS} FROM ledger WHERE unix_ts >= {NOW - 30 * 86400}"))
def q_expired(spark, sf):
    return L.prune_expired(ledger(spark, sf), NOW, 30)


# ---------------------------------------------------------------------------
# A. Sources and sinks
# ---------------------------------------------------------------------------
@query("prompts_ingest", f"""WITH {O.prompts_cte()}
SELECT doc_id, 'text' AS kind, true AS valid, prompt FROM prompts
UNION ALL SELECT doc_id, 'number', false, NULL FROM prompts
UNION ALL SELECT doc_id, 'twice', true, prompt FROM prompts
UNION ALL SELECT doc_id, 'trailing', false, NULL FROM prompts""")
def q_ingest(spark, sf):
    docs = TD.table(spark, sf, "documents").select("doc_id", TD.planted_text().alias("prompt"), "n_chars")
    body = F.to_json(F.struct("prompt"))
    bodies = docs.select("doc_id", F.explode(F.array(
        F.struct(F.lit("text").alias("kind"), body.alias("value")),
        F.struct(F.lit("twice").alias("kind"), F.concat(F.lit('{"prompt": "first", '), F.substr(body, F.lit(2))).alias("value")),
        F.struct(F.lit("trailing").alias("kind"), F.concat(body, F.lit(" junk")).alias("value")),
        F.struct(F.lit("number").alias("kind"),
                 F.concat(F.lit('{"prompt": '), F.coalesce(F.col("n_chars").cast("string"), F.lit("0")),
                          F.lit("}")).alias("value")))).alias("b")).select("doc_id", "b.kind", "b.value")
    return P.parse_prompt_requests(bodies).select("doc_id", "kind", "valid", "prompt")


@query("ledger_append", O.with_ledger(f"SELECT {LCOLS} FROM ledger"))
def q_append(spark, sf):
    path = scratch_path(spark, "ledger")
    led = ledger(spark, sf)
    IO.ledger_append(led.filter(F.col("status") == "BLOCKED"), path)   # two appends, every row once
    IO.ledger_append(led.filter(F.col("status") != "BLOCKED"), path)
    return IO.ledger_scan(spark, path).select(*LEDGER_COLUMNS)


@query("ledger_scan", O.with_ledger(f"SELECT {LCOLS}, CAST(substr(\"timestamp\", 1, 10) AS DATE) AS event_date "
                                    "FROM ledger"))
def q_scan(spark, sf):
    path = scratch_path(spark, "ledger")
    IO.ledger_append(ledger(spark, sf), path)
    return IO.ledger_scan(spark, path)


@query("ledger_dedup", O.with_ledger(f"SELECT {LCOLS} FROM ledger"))
def q_dedup(spark, sf):
    led = ledger(spark, sf)
    replay = led.withColumn("unix_ts", F.col("unix_ts") + 1.0).withColumn("latency_ms", F.lit(-1.0))
    return L.ledger_dedup(led.unionByName(replay))


@query("ledger_reset", O.with_ledger("""SELECT count(*) AS total_processed,
  count(*) FILTER (WHERE status = 'BLOCKED') AS total_blocked,
  count(*) FILTER (WHERE status = 'SANITIZED') AS total_sanitized,
  count(*) FILTER (WHERE status = 'PASSED') AS total_passed FROM ledger WHERE false"""))
def q_reset(spark, sf):
    path = scratch_path(spark, "ledger")
    IO.ledger_append(ledger(spark, sf), path)
    IO.ledger_reset(spark, path)
    return E.counters_total(IO.ledger_scan(spark, path))


def _json_cell_sql(c: str, numeric: bool) -> str:
    if numeric:
        return (f"CASE WHEN {c} IS NULL THEN '\"\"' WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) "
                f"ELSE CAST({c} AS VARCHAR) END")
    return f"CASE WHEN {c} IS NULL THEN '\"\"' ELSE CAST(to_json({c}) AS VARCHAR) END"


_CSV_ROW = " || ',' || ".join(_json_cell_sql(f'"{c}"' if c == "timestamp" else c, c in X.NUMERIC)
                              for c in X.CSV_COLUMNS)


@query("export_csv", O.with_ledger(f"""SELECT 0 AS row_no, '{",".join(X.CSV_COLUMNS)}' AS line
UNION ALL SELECT CAST(row_number() OVER (ORDER BY unix_ts DESC, id) AS INTEGER), {_CSV_ROW}
FROM (SELECT * FROM ledger ORDER BY unix_ts DESC, id LIMIT 500)"""))
def q_csv(spark, sf):
    return X.export_csv(ledger(spark, sf))


def _json_value_sql(c: str) -> str:
    q = f'"{c}"'
    if c in X.NUMERIC:
        return (f"CASE WHEN {q} IS NULL THEN 'null' WHEN {q} = floor({q}) THEN CAST(CAST({q} AS BIGINT) AS VARCHAR) "
                f"ELSE CAST({q} AS VARCHAR) END")
    return f"CASE WHEN {q} IS NULL THEN 'null' ELSE CAST(to_json({q}) AS VARCHAR) END"


_JSON_FIELDS = " || ',\n' || ".join(f"'    \"{c}\": ' || {_json_value_sql(c)}" for c in LEDGER.fieldNames())
_EXPORTED_SQL = """e AS (SELECT *, CAST(row_number() OVER (ORDER BY unix_ts DESC, id) AS INTEGER) AS row_no
FROM (SELECT * FROM ledger ORDER BY unix_ts DESC, id LIMIT 500))"""


@query("export_json", O.with_ledger(f""", {_EXPORTED_SQL}
SELECT row_no, '  {{\n' || {_JSON_FIELDS} || '\n  }}' || CASE WHEN row_no = (SELECT max(row_no) FROM e) THEN '' ELSE ',' END AS line FROM e
UNION ALL SELECT 0, CASE WHEN count(*) = 0 THEN '[]' ELSE '[' END FROM e
UNION ALL SELECT CAST(max(row_no) + 1 AS INTEGER), ']' FROM e HAVING count(*) > 0""").replace("\n\n,", "\n,"))
def q_json(spark, sf):
    return X.export_json(ledger(spark, sf))


_AUDIT_MSG = ("CASE WHEN status = 'BLOCKED' THEN 'BLOCKED [' || id || '] ip=' || coalesce(ip_address, 'unknown') "
              "|| ' rule=' || coalesce(matched_rule, '') ELSE status || ' [' || id || '] ip=' || "
              "coalesce(ip_address, 'unknown') || ' masked=' || CAST(tokens_masked AS VARCHAR) END")


@query("audit_log_scan", O.with_ledger(f"""SELECT "timestamp" AS ts,
  CASE WHEN status = 'BLOCKED' THEN 'WARNING' ELSE 'INFO' END AS level, 'gateway' AS logger,
  {_AUDIT_MSG} AS message, status, id AS event_id, coalesce(ip_address, 'unknown') AS ip,
  CASE WHEN status = 'BLOCKED' THEN NULL ELSE tokens_masked END AS masked,
  CASE WHEN status = 'BLOCKED' THEN matched_rule END AS rule FROM ledger"""))
def q_audit(spark, sf):
    path = scratch_path(spark, "audit")
    AL.write_audit_lines(AL.render_audit_lines(ledger(spark, sf)), path)
    return AL.audit_log_scan(spark, path)


@query("alert_feed", O.with_ledger("""SELECT id, "timestamp", ip_address, matched_rule FROM ledger
WHERE status = 'BLOCKED' AND severity = 'CRITICAL'"""))
def q_alert(spark, sf):
    return L.alert_feed(ledger(spark, sf)).select("id", "timestamp", "ip_address", "matched_rule")


# ---------------------------------------------------------------------------
# H. Streaming (file sources, availableNow; results read back from the sink)
# ---------------------------------------------------------------------------
def _events_stream(spark, sf) -> DataFrame:
    schema = TD.table(spark, sf, "events").schema
    # A glob path: for a plain file path the file source would use the file as its base path.
    return spark.readStream.schema(schema).parquet(f"{sf.rstrip('/')}/events.parque[t]")


def _arrivals(spark, sf) -> DataFrame:
    return TD.requests_from(_events_stream(spark, sf), TD.n_documents(spark, sf))


def _with_verdicts(spark, sf, arrivals: DataFrame) -> DataFrame:
    return S.event_project(arrivals.join(TD.scored_prompts(spark, sf), "doc_id"), text_col="prompt", ts_col="ts")


def _ledger_stream(spark, sf) -> DataFrame:
    """Ledger rows as they are appended: the arrivals with the verdicts of their texts."""
    return _with_verdicts(spark, sf, _arrivals(spark, sf))


@query("score_stream", O.with_ledger(f"SELECT {LCOLS} FROM ledger"))
def q_score_stream(spark, sf):
    # The arrivals bring their texts, and no verdicts.
    reqs = TD.requests_from(_events_stream(spark, sf), TD.n_documents(spark, sf)).join(TD.prompts(spark, sf), "doc_id")
    return spark.read.schema(LEDGER).parquet(H.run_available_now(H.score_stream(reqs), "score_stream"))


@query("counters_stream", O.with_ledger("SELECT status, count(*) AS count FROM ledger GROUP BY status"))
def q_counters_stream(spark, sf):
    return spark.read.parquet(H.run_available_now(H.counters_stream(_ledger_stream(spark, sf)),
                                                  "counters_stream", mode="complete"))


@query("counters_stored", O.with_ledger("""SELECT count(*) AS total_processed,
  count(*) FILTER (WHERE status = 'BLOCKED') AS total_blocked,
  count(*) FILTER (WHERE status = 'SANITIZED') AS total_sanitized,
  count(*) FILTER (WHERE status = 'PASSED') AS total_passed FROM ledger"""))
def q_counters_stored(spark, sf):
    """Totals kept beside a ledger that each batch prunes to its newest 500 rows."""
    root = scratch_path(spark, "counters")
    prune, count = H.retention_batch_writer(spark, f"{root}/snapshots", 500), H.counters_batch_writer(f"{root}/counts")

    def write(batch: DataFrame, batch_id: int) -> None:
        count(batch, batch_id)
        prune(batch, batch_id)

    _ledger_stream(spark, sf).writeStream.option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return H.stored_counters(spark, f"{root}/counts")


@query("hourly_stream", O.with_ledger(f"""SELECT substr("timestamp", 1, 13) || ':00' AS hour, status,
  count(*) AS count, {_AVG_LAT} AS avg_latency FROM ledger GROUP BY 1, 2"""))
def q_hourly_stream(spark, sf):
    return spark.read.parquet(H.run_available_now(H.hourly_stream(_ledger_stream(spark, sf)), "hourly_stream",
                                                  mode="complete"))


@query("rate_limit_stream", _with_rl("SELECT id, admitted FROM rl"))
def q_rl_stream(spark, sf):
    reqs = TD.requests_from(_events_stream(spark, sf), TD.n_documents(spark, sf))
    out = H.rate_limit_stream(reqs, "ip_address", "unix_ts", "id", RL_LIMIT, RL_WINDOW)
    return spark.read.parquet(H.run_available_now(out, "rate_limit_stream", timers=True))


@query("dedup_stream", O.with_ledger(f"SELECT {LCOLS} FROM ledger"))
def q_dedup_stream(spark, sf):
    arrivals = TD.requests_from(_events_stream(spark, sf), TD.n_documents(spark, sf))
    first = H.dedup_stream(arrivals.unionByName(arrivals))  # every event delivered twice; texts join those that stay
    # An id is one row whatever the number of its documents.
    scored = S.score_prompts(TD.prompts(spark, sf).dropDuplicates(["doc_id"]), "prompt")
    rows = S.event_project(first.join(scored, "doc_id"), text_col="prompt", ts_col="ts")
    return spark.read.schema(LEDGER).parquet(H.run_available_now(rows, "dedup_stream"))


@query("dedup_into_ledger", O.with_ledger(f"SELECT {LCOLS} FROM ledger"))
def q_dedup_into_ledger(spark, sf):
    """Every event delivered twice, into a ledger that already holds those of even numbers."""
    root = scratch_path(spark, "dedup-ledger")
    led = ledger(spark, sf)
    IO.ledger_append(led.filter(F.substring("id", -1, 1).cast("int") % 2 == 0), f"{root}/ledger")
    arrivals, keep_new = _arrivals(spark, sf), H.dedup_batch_writer(spark, f"{root}/ledger")

    def write(batch: DataFrame, batch_id: int) -> None:
        # Verdicts join within the batch's own job, whose shuffle files go with it; a stream's stay until its next batch.
        keep_new(_with_verdicts(spark, sf, batch), batch_id)

    arrivals.unionByName(arrivals).writeStream.option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True) \
        .foreachBatch(write).start().awaitTermination()
    return IO.ledger_scan(spark, f"{root}/ledger").select(*LEDGER.fieldNames())


@query("retention_stream", O.with_ledger(f"SELECT {LCOLS} FROM ledger ORDER BY unix_ts DESC, id LIMIT 500"))
def q_retention_stream(spark, sf):
    root = scratch_path(spark, "retention")
    q = (_ledger_stream(spark, sf).writeStream
         .option("checkpointLocation", f"{root}/_checkpoint").trigger(availableNow=True)
         .foreachBatch(H.retention_batch_writer(spark, f"{root}/snapshots", 500)).start())
    q.awaitTermination()
    return H.latest_snapshot(spark, f"{root}/snapshots").select(*LEDGER_COLUMNS)
