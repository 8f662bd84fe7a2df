"""Secret scans: keyword automaton, anchored expressions near its hits, checksum validation.

An Aho-Corasick automaton finds the literal that every kind of secret must contain; only
there an anchored expression runs on the text. Token formats that carry a checksum or
encoded structure are reported only if it holds. Runs of hexadecimal digits have no
keyword; one expression for long runs finds them.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# FIXED VALUES: the base kinds, their expressions and shortest lengths; kinds are listed in report order.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_VALUE, ACCESS_LENGTH = 8, 16
# Further kinds: token formats with an embedded CRC-32 in base 62, signed web tokens, private key blocks.
GITHUB = re.compile(r"(gh[pousr]_)([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
NPM = re.compile(r"(npm_)([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+")
# A token's first part is the rest of its run; what follows the run decides for all hits within it.
JWT_RUN, JWT_REST = re.compile(r"[A-Za-z0-9_-]*"), re.compile(r"\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]")
PEM = re.compile(r"-----BEGIN ((?:[A-Z]+ )*)PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END \1PRIVATE KEY-----")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",), "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",), "jwt": ("eyj",), "pem": ("-----begin ",),
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"

Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            a.add_word(w, (len(w), KINDS.index(kind)))
    a.make_automaton()
    return a


_LOWER = {i: i + 32 for i in range(65, 91)}


def _lower(text: str) -> str:
    """Lower case of the same length; hits are checked on the text itself."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_LOWER)


def crc_base62(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out.rjust(6, "0")


def _json(part: str) -> object:
    try:
        return json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return None


def _valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[1]) >= ASSIGN_VALUE
    if kind == "access":
        return len(m[0]) >= ACCESS_LENGTH
    if kind in ("github", "npm"):
        return crc_base62(m[2]) == m[3]
    if kind == "jwt":
        head = _json(m[1])
        return isinstance(head, dict) and "alg" in head and isinstance(_json(m[2]), dict)
    try:
        return len(base64.b64decode("".join(m[2].split()), validate=True)) >= 16
    except (ValueError, binascii.Error):
        return False


EXPRESSIONS = {"assign": ASSIGN, "access": ACCESS, "github": GITHUB, "npm": NPM, "jwt": JWT, "pem": PEM}


def find_secrets(text: str, automaton: ahocorasick.Automaton) -> list[Span]:
    """All spans of a text by start and kind; per kind leftmost and not overlapping.

    A match that fails its validation still takes its place, so that later matches
    are those a plain left-to-right search would find.
    """
    spans = [(m.start(), KINDS.index("hex"), m.end()) for m in HEX.finditer(text)]
    past = [0] * len(KINDS)
    # Hits come by their end; the keywords of one kind must be tried by their start.
    hits = sorted({(end - size + 1, kind) for end, (size, kind) in automaton.iter(_lower(text))})
    run = 0
    for at, kind in hits:
        if KINDS[kind] == "jwt" and at >= run:
            run = JWT_RUN.match(text, at).end()
            if not JWT_REST.match(text, run):
                past[kind] = max(past[kind], run)
        if at >= past[kind] and (m := EXPRESSIONS[KINDS[kind]].match(text, at)):
            past[kind] = m.end()
            if _valid(KINDS[kind], m):
                spans.append((at, kind, m.end()))
    return sorted(spans)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start and then kind.
    ``base_sha256`` covers the first three kinds. A null text is empty: no spans, the
    digest of the empty string. Repeated rows give repeated results, an empty table none;
    other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for b in batches:
            out: list[list] = [b.column(0).to_pylist(), [], [], [], [], []]
            for text in b.column(1).to_pylist():
                spans = find_secrets(text or "", automaton)
                base = [s for s in spans if s[1] < 3]
                for k in range(3):
                    out[1 + k].append(sum(s[1] == k for s in base))
                out[4].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                out[5].append(_joined(spans))
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)],
                                             names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, RESULT)
