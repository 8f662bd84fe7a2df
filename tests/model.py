"""Plain-Python statement of the gateway semantics, used as a brute-force check.

Small loops over Python lists: the slow, obviously-correct form the Spark
operators are compared with on fixtures and on the small test tables.
"""

from __future__ import annotations

import re

from promptlens.functions.rules import INJECTION_RULES, PII_ALTERNATION, PII_RULE_LABEL, REDACTION_MARK

PII_RE = re.compile(PII_ALTERNATION, re.IGNORECASE)


def score(text: str):
    """(status, severity, rule, sanitized_text, tokens_masked)."""
    low = text.lower()
    for term, sev, label in INJECTION_RULES:
        if term in low:
            return "BLOCKED", sev, label, text, 0
    red, n = PII_RE.subn(REDACTION_MARK, text)
    if n:
        return "SANITIZED", "MEDIUM", PII_RULE_LABEL, red, n
    return "PASSED", "LOW", None, text, 0


def pii_types(text: str) -> list[int]:
    """1-based pattern index of every PII match, in order."""
    return [next(g for g in range(1, 11) if m.group(g) is not None) for m in PII_RE.finditer(text)]


def rate_limit(requests, limit, window):
    """requests: list of (key, ts, id) in any order -> {id: admitted}."""
    store: dict = {}
    out = {}
    for key, ts, rid in sorted(requests, key=lambda r: (r[1], r[2])):
        hits = [t for t in store.get(key, []) if ts - t < window]
        if len(hits) >= limit:
            out[rid] = False
            store[key] = hits
            continue
        hits.append(ts)
        store[key] = hits
        out[rid] = True
    return out


def replay_rules(changes):
    """changes: (seq, op, id, name, pattern, severity, enabled, ts) -> {id: row}."""
    table: dict = {}
    for seq, op, rid, name, pattern, sev, enabled, ts in sorted(changes):
        en = True if enabled is None else enabled
        if op == "insert":
            if rid not in table:
                table[rid] = (name, pattern, sev, en, ts)
        elif op == "update":
            if rid in table:
                table[rid] = (name, pattern, sev, en, table[rid][4])
        elif op == "delete":
            table.pop(rid, None)
    return table
