import hashlib
import re

from conftest_llm import SF_SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from promptlens.llm import queries, secrets

AUTOMATON = secrets._automaton()
BASE = {"assign": re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
        "access": re.compile(r"AKIA[A-Z0-9]+"), "hex": re.compile(r"[0-9a-f]+")}
LEAST = {"assign": lambda m: len(m[2]) >= 8, "access": lambda m: len(m[0]) >= 16, "hex": lambda m: len(m[0]) >= 32}


def brute(text):
    return sorted((m.start(), list(BASE).index(k), m.end()) for k, e in BASE.items() for m in e.finditer(text) if LEAST[k](m))


PIECES = st.sampled_from(["password", "PassWD", "secret", "toKen", "api_key", "APIKEY", "=", ":", " ", '"', "'", "AKIA", "AKIAABCDEFGHIJKL", "a1b2c3d4e5f60718" * 2,
                          "deadbeef", "İ", "ſecret", "toKen", "x=y/z+12345", "\n", "Z9", "-", "."])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=25).map("".join))
def test_base_spans_are_those_of_a_plain_search(text):
    assert [s for s in secrets.find_secrets(text, AUTOMATON) if s[1] < 3] == brute(text)


def test_checksums_and_structure():
    good = "ghp_" + "Zx" * 15 + secrets.crc_base62("Zx" * 15)
    bad = "ghp_" + "Zx" * 15 + "000000"
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.c2ln"
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "QUJD" * 12 + "\n-----END RSA PRIVATE KEY-----"
    kinds = lambda t: [secrets.KINDS[k] for _, k, _ in secrets.find_secrets(t, AUTOMATON)]
    assert kinds(f"x {good} y {bad} z") == ["github"]
    assert kinds(jwt) == ["jwt"] and kinds("eyJhbGci.eyJzdWI.c2ln") == []
    assert kinds(pem) == ["pem"] and kinds(pem.replace("QUJD", "Q*JD")) == []
    assert kinds("npm_" + "Yq" * 15 + secrets.crc_base62("Yq" * 15)) == ["npm"]


def test_query_over_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = queries.op2_secrets(spark, SF_SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute(texts[r.doc_id] or "")
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in want) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(secrets._joined(want).encode()).hexdigest()
    assert sum(r.n_assign for r in got) > 0


JWT_PIECES = st.sampled_from(["eyJ", "eyj", "EYJ", "eyJh", ".", "..", "x-_", "eyJhbGciOiJIUzI1NiJ9", "eyJzdWIiOiIxIn0", "c2ln", " "])


@settings(max_examples=300, deadline=None)
@given(st.lists(JWT_PIECES, max_size=14).map("".join))
def test_web_tokens_are_those_of_a_plain_search(text):
    want, past = [], 0
    for at in range(len(text)):
        if at >= past and (m := secrets.JWT.match(text, at)):
            past = m.end()
            if secrets._valid("jwt", m):
                want.append((at, secrets.KINDS.index("jwt"), m.end()))
    assert [s for s in secrets.find_secrets(text, AUTOMATON) if secrets.KINDS[s[1]] == "jwt"] == want


def test_long_runs_of_keywords_take_linear_time():
    """A run of half a million characters of one token's beginning, in every ending, within seconds."""
    import time
    start = time.time()
    for word in ("eyJ", "eyj", "eyJeyj", "token", "AKIA", "akia", "secret=", "-----BEGIN ", "-----BEGIN PRIVATE KEY-----\n", "ghp_"):
        for end in ("", ".", ".eyJx", ".eyJx.", " "):
            secrets.find_secrets(word * (200_000 // len(word)) + end, AUTOMATON)
    assert time.time() - start < 60
