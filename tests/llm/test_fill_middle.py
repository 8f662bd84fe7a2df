import hashlib

import pytest
from conftest_llm import EDGES, SF_SMALL

from promptlens.llm import fill_middle as M
from promptlens.llm import queries


def brute(i, text, fmt=M.Format()):
    """(n, form, prefix_chars, middle_chars, output) of one row, by slices."""
    text = text or ""
    h = hashlib.sha256(f"{fmt.seed}{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not n or any(m in text for m in (fmt.prefix, fmt.suffix, fmt.middle)) or h3 % 100 >= fmt.rate:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < fmt.suffix_first:
        return n, "spm", a, b - a, fmt.suffix + s + fmt.prefix + p + fmt.middle + m
    return n, "psm", a, b - a, fmt.prefix + p + fmt.suffix + s + fmt.middle + m


def held(spark, make, texts, fmt=M.Format()):
    out = M.fill_in_middle(make([(i, t, None, None) for i, t in texts]), fmt=fmt)
    out = out.withColumn("restored", M.restore(out["output"], out["form"], fmt))
    got = sorted((tuple(r) for r in out.collect()), key=str)
    assert got == sorted(((i, *brute(i, t, fmt), t or "") for i, t in texts), key=str)
    return got


def test_rows_are_those_of_slices(spark, make):
    texts = [(i, ("aé\U0001f600\n\r\x85  $1 \\2 \\E {3}" * (i % 7))[:i]) for i in range(300)]
    forms = {r[2] for r in held(spark, make, texts)}
    assert forms == {"plain", "psm", "spm"}


def test_markers_and_their_parts(spark, make):
    held(spark, make, [(i, t) for i, t in enumerate(["<P>", "x<S>y", "<M", "<<P", "<P<S<M" * 9, "<S" * 50, "<" * 99, ">P<S", "P>", "", None] * 4)])


def test_markers_with_special_characters(spark, make):
    fmt = M.Format(prefix="\\E$0", suffix="(.*)\\", middle="$1[", rate=100, suffix_first=50, seed="x")
    held(spark, make, [(i, "some $ text \\ with (.*) parts " * (i + 1)) for i in range(40)], fmt)


@pytest.mark.parametrize("n", [M.BLOCK - 1, M.BLOCK, M.BLOCK + 1, 3 * M.BLOCK + 5, 2_000_000])
def test_long_texts_are_cut_whole(spark, make, n):
    held(spark, make, [(i, "\U0001f600" + "x\ny" * (n // 3) + "z" * (n % 3) + "é") for i in range(3)])


def test_edge_rows(spark, edges, nothing):
    got = sorted((tuple(r) for r in M.digests(edges).collect()), key=str)
    want = []
    for i, t, *_ in EDGES:
        *first, output = brute(i, t)
        want.append((i, *first, hashlib.sha256(output.encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert M.digests(nothing).collect() == []


def test_null_ids(spark, make):
    held(spark, make, [(None, "some text that is cut"), (None, None), (-5, "negative ids have a sign"), (2 ** 63 - 1, "large")])


def test_query_is_a_projection(spark):
    plan = queries.op11_fill_middle(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
