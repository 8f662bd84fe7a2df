import math
from collections import Counter

import pytest
from conftest_llm import SF_SMALL
from pyspark.sql import functions as F

from promptlens.llm import queries
from promptlens.llm import url_filter as U


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:at])
    path = rest[at:]
    return host, path[:min([path.find(c) for c in "?#" if c in path] or [len(path)])]


def rule(host, path):
    best = None
    for text, say in U.RULES:
        suffix, _, start = text.partition("/")
        if (host == suffix or host.endswith("." + suffix)) and path.startswith("/" + start) and (best is None or len(text) > len(best[0])):
            best = (text, say)
    return best


def test_query_over_whole_table(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("page_id", "url").collect()}
    got = queries.op7_url_filter(spark, SF_SMALL).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path) == parts(urls[r.page_id])
        fits = rule(r.host, r.path)
        assert r.rule == (fits and fits[0]) and r.verdict in ("allow", "block")
        assert fits is None or r.verdict == fits[1]


@pytest.mark.parametrize("url", [None, "", "no scheme", "http://", "HTTP://A.Example.ORG/es/1?x#y", "x://example.org/en/1", "x://example.org/en/2", "a://b://c.com/de/",
                                 "s://com/fr/x", "s://notcom/fr/x", "s://x.com?/de/", "s://org", "s://ORG/", "s://É.org/a#b?c", "s://e.com/de\n/"])
def test_parse(spark, url):
    r = U.filter_urls(spark.createDataFrame([(1, url)], "page_id long, url string")).first()
    assert (r.host, r.path) == parts(url)
    assert r.rule == ((rule(*parts(url)) or [None])[0])


def test_learned_verdicts_on_held_out_urls(spark):
    rows = U.lexical(U.parsed(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"), "page_id", "url", U.RULES)).where("said is not null")
    held = F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(4)) == 0
    model, stats = U.fit(rows.where(~held))
    right = U.judge(rows.where(held), model, stats).agg(F.avg((F.col("learned") == F.col("said")).cast("int"))).first()[0]
    assert right > 0.9


def test_entropy(spark):
    url = "http://aab.example.com/x?y=1"
    got = U.lexical(U.parsed(spark.createDataFrame([(1, url)], "page_id long, url string"), "page_id", "url", ())).first()
    want = -sum(n / len(url) * math.log2(n / len(url)) for n in Counter(url).values())
    assert abs(got.f_entropy - want) < 1e-9 and got.f_params == 1.0 and got.tld == "com" and got.domain == "example.com"
