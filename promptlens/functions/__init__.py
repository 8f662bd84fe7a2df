from promptlens.functions.rules import (  # noqa: F401
    INJECTION_RULES, PII_PATTERNS, PII_REGEX, REDACTION_MARK, injection_verdict,
    injection_all_hits, pii_count, pii_redact, pii_group_counts, severity_rank,
)
from promptlens.functions.text import (  # noqa: F401
    snippet, payload_bytes, sqlite_like_search, literal_search, json_cell,
)
