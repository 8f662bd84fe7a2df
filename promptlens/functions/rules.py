"""Built-in detection rules and their compilation into Spark Column expressions.

Everything here is a native Catalyst expression: the 18 phrase checks become one
``CASE WHEN`` chain (short-circuits on the first hit, like a loop over the list)
and the ten PII patterns become one Java regex alternation that Spark compiles
once per task because the pattern is a literal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# FIXED VALUES — must equal the reference for identical verdicts.
# Injection phrases in priority order: (phrase, severity, rule label).
# ---------------------------------------------------------------------------
INJECTION_RULES: list[tuple[str, str, str]] = [
    ("ignore previous instructions", "CRITICAL", "Instruction override"),
    ("system override", "CRITICAL", "System override"),
    ("reveal your system prompt", "CRITICAL", "System prompt extraction"),
    ("translate the above", "HIGH", "Context leak"),
    ("disregard all prior", "CRITICAL", "Instruction wipe"),
    ("forget your instructions", "CRITICAL", "Instruction wipe"),
    ("act as dan", "CRITICAL", "DAN jailbreak"),
    ("jailbreak", "HIGH", "Jailbreak keyword"),
    ("bypass your filters", "HIGH", "Filter bypass"),
    ("disable safety", "CRITICAL", "Safety disable"),
    ("pretend you have no restrictions", "HIGH", "Restriction bypass"),
    ("you are now", "MEDIUM", "Role override"),
    ("new persona", "MEDIUM", "Persona injection"),
    ("developer mode", "HIGH", "Dev mode bypass"),
    ("sudo mode", "HIGH", "Privilege escalation"),
    ("override all policies", "CRITICAL", "Policy override"),
    ("respond as", "MEDIUM", "Role override"),
    ("from now on", "MEDIUM", "Instruction override"),
]

# FIXED VALUES — PII / credential patterns in order: (regex, label).
PII_PATTERNS: list[tuple[str, str]] = [
    (r"sk-[a-zA-Z0-9]{20,}", "OpenAI API key"),
    (r"AI_KEY_[a-zA-Z0-9]{8,}", "Internal API key"),
    (r"ghp_[a-zA-Z0-9]{36,}", "GitHub token"),
    (r"AKIA[0-9A-Z]{16}", "AWS access key"),
    (r"Bearer\s+[a-zA-Z0-9\-._~+/]+=*", "Bearer token"),
    (r"password\s*[:=]\s*\S+", "Password literal"),
    (r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "Email address"),
    (r"\b(?:\d[ \-]?){15,16}\b", "Credit card"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "SSN"),
    (r"\b(\+\d{1,3}[\s\-]?)?\(?\d{3}\)?[\s.\-]?\d{3}[\s.\-]?\d{4}\b", "Phone number"),
]

# FIXED VALUES — verdict vocabulary.
REDACTION_MARK = "[REDACTED]"
PII_RULE_LABEL = "PII / credential detected"
STATUS_BLOCKED, STATUS_SANITIZED, STATUS_PASSED = "BLOCKED", "SANITIZED", "PASSED"
SEVERITY_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}

# One alternation, each pattern in its own group (group i+1 = pattern i; the
# phone pattern's inner group is number 11), in the reference's regex dialect.
PII_ALTERNATION = "|".join(f"({p})" for p, _ in PII_PATTERNS)

# Execution form for Java. The e-mail alternative starts with a run of
# EMAIL_LOCAL characters, so a match of it that starts inside such a run also
# matches from the run's first character, which the scan reaches earlier; it can
# therefore only win at a run start or where the previous match ended (\G).
# Guarding it this way skips the hopeless attempts at every later character of
# every word and leaves the matches unchanged. RE2 (the SQL oracle) has no
# lookbehind and uses PII_ALTERNATION as is.
EMAIL_LOCAL = r"[a-zA-Z0-9._%+\-]"
_EMAIL = PII_PATTERNS[6][0]
assert _EMAIL.startswith(EMAIL_LOCAL + "+@")

# The dialect's word characters are letters, numbers and "_" (no marks, no joiners), and its
# white space includes U+001C..U+001F; Java's classes differ even with (?U), so both are spelled
# out. Java flags: i = ignore case, u = Unicode case folding, U = Unicode \\d.
# A letter beyond U+FFFF in the class makes Java's lookbehind step by code points.
_WORD = r"[\p{L}\p{N}_" + "\U00010400]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_SPACES = r"\s\x1c-\x1f"


def _java_form(pattern: str) -> str:
    """``pattern`` for Java: \\b, \\s and \\S replaced, inside or outside of a class.

    A leading boundary is tried only where a digit, plus or bracket follows, as all the
    patterns that begin with one must.
    """
    out, i, in_class = "", 0, False
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two == r"\b":
            out += ("" if i else r"(?=[\d+(])") + _BOUNDARY
        elif two == r"\s":
            out += _SPACES if in_class else f"[{_SPACES}]"
        elif two == r"\S":
            out += f"[^{_SPACES}]"
        elif two[0] == "\\":
            out += two
        else:
            in_class = two[0] == "[" or in_class and two[0] != "]"
            out += two[0]
            i -= 1
        i += 2
    return out


# What a match of any pattern but the e-mail's begins with ("s" in both cases and the long s, which
# folds to it): elsewhere the ten alternatives are not tried one by one.
_FIRST = r"(?=(?-iu:[sS\u017FaAgGbBpP+(]|\p{Nd}))"


def _alternation(with_email: bool) -> str:
    """A text without "@" has no e-mail match, so that alternative (the dearest) then never matches."""
    run_start = f"(?<!{EMAIL_LOCAL})|\\G"
    # The run before "@" holds no "@", so it is never shortened: a possessive run finds the same.
    email = f"(?:{run_start}){EMAIL_LOCAL}+{_EMAIL.removeprefix(EMAIL_LOCAL)}" if with_email else "(?!)"
    any_of = "|".join(f"({email if p == _EMAIL else _java_form(p)})" for p, _ in PII_PATTERNS)
    return f"(?iuU)(?:{_FIRST}|{run_start})(?:{any_of})" if with_email else f"(?iuU){_FIRST}(?:{any_of})"


PII_REGEX = _alternation(True)
PII_REGEX_NO_AT = _alternation(False)


def _by_at(text: Column, apply) -> Column:
    """``apply(regex)`` with the shorter regex where the text has no "@"."""
    return F.when(text.contains("@"), apply(F.lit(PII_REGEX))).otherwise(apply(F.lit(PII_REGEX_NO_AT)))


def injection_verdict(text: Column, rules: list[tuple[str, str, str]] | None = None) -> Column:
    """struct<severity, rule, rank> of the first phrase contained in lower(text), else null.

    ``CASE`` evaluates branches in order and stops at the first true one, so the
    cost on a blocked row is the prefix of the list up to its hit.
    """
    rules = INJECTION_RULES if rules is None else rules
    lowered = F.lower(text)
    expr = None
    for rank, (term, severity, label) in enumerate(rules, start=1):
        hit = F.struct(F.lit(severity).alias("severity"), F.lit(label).alias("rule"),
                       F.lit(rank).alias("rank"))
        cond = lowered.contains(term)
        expr = F.when(cond, hit) if expr is None else expr.when(cond, hit)
    return expr


def injection_all_hits(text: Column) -> Column:
    """array<struct<rank, term, severity, rule>> of every phrase contained in the text.

    The text is lower-cased once, as the only element of an array that a lambda binds.
    """
    def hits(lowered: Column) -> Column:
        return F.array_compact(F.array(*[
            F.when(lowered.contains(t), F.struct(F.lit(i).alias("rank"), F.lit(t).alias("term"),
                                                 F.lit(s).alias("severity"), F.lit(r).alias("rule")))
            for i, (t, s, r) in enumerate(INJECTION_RULES, start=1)]))
    return F.transform(F.array(F.lower(text)), hits)[0]


def pii_count(text: Column) -> Column:
    """Number of leftmost non-overlapping PII matches (= replacements made)."""
    return _by_at(text, lambda regex: F.regexp_count(text, regex))


def pii_redact(text: Column) -> Column:
    return _by_at(text, lambda regex: F.regexp_replace(text, regex, F.lit(REDACTION_MARK)))


def marks_in(text: Column) -> Column:
    """Occurrences of the redaction mark (a literal search, no regex)."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(REDACTION_MARK), F.lit(""))))
            / F.lit(len(REDACTION_MARK))).cast("int")


_SEG_OPEN, _SEG_SEP, _SEG_CLOSE = "\u0001", "\u0002", "\u0003"


def pii_match_patterns(text: Column) -> Column:
    """array<int>: for every match, in order, the 1-based index of the pattern that won it.

    One regex pass: each match is replaced by OPEN $1 SEP $2 ... SEP $10 CLOSE,
    where only the winning alternative's group is non-empty; the markers are
    then split back out with literal searches. Rows whose text already holds a
    marker character take the exact per-group form (``pii_group_counts``).
    """
    n = len(PII_PATTERNS)
    groups = F.lit(_SEG_OPEN + _SEG_SEP.join(f"${g}" for g in range(1, n + 1)) + _SEG_CLOSE)
    enc = _by_at(text, lambda regex: F.regexp_replace(text, regex, groups))
    segs = F.regexp_extract_all(enc, F.lit(f"{_SEG_OPEN}([^{_SEG_CLOSE}]*){_SEG_CLOSE}"), F.lit(1))
    return F.transform(segs, lambda sg: F.array_position(
        F.transform(F.split(sg, _SEG_SEP), lambda x: x != F.lit("")), F.lit(True)).cast("int"))


def pii_pattern_counts(text: Column) -> Column:
    """array<int> with the number of matches won by each of the ten patterns.

    One regex pass (``pii_match_patterns``), referenced exactly once and folded
    into ten counters, so the optimizer has no copy of the regex to inline
    elsewhere. Rows holding a marker character take ``pii_group_counts``.
    """
    n = len(PII_PATTERNS)

    def bump(acc, g):
        return F.transform(acc, lambda c, i: c + F.when(i + 1 == g, 1).otherwise(0))

    fast = F.aggregate(pii_match_patterns(text), F.array_repeat(F.lit(0), n), bump)
    has_marker = text.rlike(f"[{_SEG_OPEN}{_SEG_SEP}{_SEG_CLOSE}]")
    return F.when(has_marker, pii_group_counts(text)).otherwise(fast)


def pii_group_counts(text: Column) -> Column:
    """array<int> with the number of matches won by each of the ten patterns.

    ``regexp_extract_all(text, alt, g)`` lists group g for every match of the
    whole alternation, with '' where another alternative won; counting the
    non-empty entries attributes each match to exactly one pattern.
    """
    return F.array(*[
        F.size(F.filter(F.regexp_extract_all(text, F.lit(PII_REGEX), F.lit(g)), lambda x: x != ""))
        for g in range(1, len(PII_PATTERNS) + 1)
    ])


def severity_rank(sev: Column) -> Column:
    expr = None
    for name, rank in SEVERITY_RANK.items():
        expr = F.when(sev == name, F.lit(rank)) if expr is None else expr.when(sev == name, F.lit(rank))
    return expr.otherwise(F.lit(0))
