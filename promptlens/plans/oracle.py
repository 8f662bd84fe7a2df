"""DuckDB SQL twins of the adapter and the verdict logic (oracle side only).

These strings are what the correctness check runs in DuckDB next to the Spark
plan. DuckDB's regex engine (RE2) has ASCII ``\\b``; the reference's engine is
Unicode-aware. The one case that occurs in the data — a card number whose last
separator is followed by a non-ASCII letter, where the Unicode reading keeps
the separator inside the match — is emulated by tagging card matches and
widening them in a second pass.
"""

from __future__ import annotations

from promptlens.functions import rules as R
from promptlens.plans import testdata as TD


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


PII_ALT_SQL = q(R.PII_ALTERNATION)
CARD_GROUP = 8  # 1-based position of the card pattern in the alternation


def _sql_token(tok: str) -> str:
    md5 = "md5(CAST(doc_id AS VARCHAR))"
    return {
        "ID": "CAST(doc_id AS VARCHAR)",
        "MD5": md5,
        "MD5_10": f"substr({md5}, 1, 10)",
        "MD5_12": f"substr({md5}, 1, 12)",
        "MD5U16": f"upper(substr({md5}, 1, 16))",
    }[tok]


def planted_text_sql() -> str:
    whens = []
    for key, parts in TD.PLANTS.items():
        cat = " || ".join(_sql_token(p) if p in TD.TOKENS else q(p) for p in parts)
        whens.append(f"WHEN {key} THEN {cat} || coalesce(text, '')")
    return f"CASE doc_id % {TD.PLANT_MODULUS} " + " ".join(whens) + " ELSE coalesce(text, '') END"


def injection_rank_sql(text: str = "prompt") -> str:
    whens = " ".join(f"WHEN contains(lower({text}), {q(t)}) THEN {i}"
                     for i, (t, _, _) in enumerate(R.INJECTION_RULES, start=1))
    return f"CASE {whens} END"


def rank_to(field: int, rank: str = "inj_rank") -> str:
    whens = " ".join(f"WHEN {i} THEN {q(r[field])}" for i, r in enumerate(R.INJECTION_RULES, start=1))
    return f"CASE {rank} {whens} END"


def pii_count_sql(text: str) -> str:
    return f"len(regexp_extract_all({text}, {PII_ALT_SQL}, 0, 'i'))"


def pii_redact_sql(text: str) -> str:
    tagged = f"regexp_replace({text}, {PII_ALT_SQL}, chr(1) || '\\{CARD_GROUP}' || chr(2), 'gi')"
    widened = (f"regexp_replace({tagged}, chr(1) || '[^' || chr(2) || ']+' || chr(2) || '[ \\-]([\\pL\\pN])', "
               f"'{R.REDACTION_MARK}\\1', 'g')")
    return f"regexp_replace({widened}, chr(1) || '[^' || chr(2) || ']*' || chr(2), '{R.REDACTION_MARK}', 'g')"


def prompts_cte() -> str:
    return f"prompts AS (SELECT doc_id, {planted_text_sql()} AS prompt FROM documents)"


def scored_cte(enable_injection: bool = True, enable_pii: bool = True) -> str:
    inj = injection_rank_sql() if enable_injection else "CAST(NULL AS INTEGER)"
    cnt = pii_count_sql("prompt") if enable_pii else "0"
    return f"""inj AS (SELECT doc_id, prompt, {inj} AS inj_rank FROM prompts),
cnt AS (SELECT *, CASE WHEN inj_rank IS NULL THEN {cnt} ELSE 0 END AS n FROM inj),
scored AS (SELECT doc_id, prompt,
  CASE WHEN inj_rank IS NOT NULL THEN 'BLOCKED' WHEN n > 0 THEN 'SANITIZED' ELSE 'PASSED' END AS status,
  CASE WHEN inj_rank IS NOT NULL THEN {rank_to(1)} WHEN n > 0 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
  CASE WHEN inj_rank IS NOT NULL THEN {rank_to(2)} WHEN n > 0 THEN {q(R.PII_RULE_LABEL)} END AS matched_rule,
  CASE WHEN n > 0 THEN {pii_redact_sql('prompt')} ELSE prompt END AS sanitized_text,
  CAST(n AS INTEGER) AS tokens_masked
FROM cnt)"""


def requests_cte() -> str:
    return f"""requests AS (SELECT event_id,
  {q(TD.ID_PREFIX)} || lpad(CAST(event_id AS VARCHAR), {TD.ID_DIGITS}, '0') AS id,
  ts, epoch_us(ts) / 1000000.0 AS unix_ts,
  CASE WHEN event_id % {TD.NULL_IP_EVERY} = 0 THEN NULL
       ELSE '10.0.' || CAST(user_id // 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) END AS ip_address,
  value AS latency_ms,
  event_id % (SELECT count(*) FROM documents) AS doc_id
FROM events)"""


def ledger_cte() -> str:
    return f"""ledger AS (SELECT r.id, strftime(r.ts, '%Y-%m-%d %H:%M:%S') AS "timestamp", r.unix_ts,
  s.status, s.severity, round(r.latency_ms, 2) AS latency_ms,
  CAST(CASE WHEN s.status = 'BLOCKED' THEN 0 ELSE s.tokens_masked END AS INTEGER) AS tokens_masked,
  CAST(strlen(s.prompt) AS INTEGER) AS payload_bytes, s.matched_rule, s.prompt AS full_payload,
  CASE WHEN s.status = 'BLOCKED' THEN '' ELSE s.sanitized_text END AS sanitized_payload,
  r.ip_address,
  CASE WHEN length(s.prompt) > 80 THEN substr(s.prompt, 1, 80) || '...' ELSE s.prompt END AS snippet
FROM requests r JOIN scored s ON r.doc_id = s.doc_id)"""


def with_scored(body: str, **kw) -> str:
    return f"WITH {prompts_cte()},\n{scored_cte(**kw)}\n{body}"


def with_ledger(body: str) -> str:
    return f"WITH {prompts_cte()},\n{scored_cte()},\n{requests_cte()},\n{ledger_cte()}\n{body}"
