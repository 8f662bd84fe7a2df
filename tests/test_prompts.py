"""Request bodies against the rules of the request model."""

import pytest
from pyspark.sql import functions as F

from promptlens.sources import prompts as P

VALID = [('{"prompt": "a"}', "a"), ('{"prompt": ""}', ""), ('{"prompt":"a","prompt":"b"}', "b"), ('{"prompt":1,"prompt":"b"}', "b"),
         (' {"other": [1, {"prompt": 2}], "prompt": "\\u00e9\\n"}\n', "\u00e9\n"), ('\ufeff{"prompt": "a"}', "a"), ('{"n": NaN, "prompt": "a"}', "a")]
INVALID = ['{"prompt":"x"} junk', '{"prompt":"x"}{"prompt":"y"}', '{"prompt":"a","prompt":1}', '{"prompt": 1}', '{"prompt": null}', "{}", "[]",
           '["prompt"]', '"prompt"', "", "not json", '{"prompt": "x"', '{"prompt": ["x"]}', '{"Prompt": "x"}', '{"prompt": "\\ud800"}',
           '{"n": ' + "1" * 5000 + ', "prompt": "a"}', '{"prompt": "a", "deep": ' + "[" * 200000 + "]" * 200000 + "}", None]


def test_bodies(spark):
    df = spark.createDataFrame([(b,) for b, _ in VALID] + [(b,) for b in INVALID], "value string")
    got = {r.value: (r.valid, r.prompt) for r in P.parse_prompt_requests(df).collect()}
    assert got == {**{b: (True, p) for b, p in VALID}, **{b: (False, None) for b in INVALID}}
    assert P.parse_prompt_requests(df.limit(0)).collect() == []


def test_a_body_has_no_size_limit(spark):
    size = 130 * 1024 * 1024
    body = F.concat(F.lit('{"prompt":"'), F.repeat(F.lit("x"), size), F.lit('"}'))
    got = P.parse_prompt_requests(spark.range(1, numPartitions=1).select(body.alias("value"))).select("valid", F.length("prompt").alias("n")).collect()
    assert [(r.valid, r.n) for r in got] == [(True, size)]


@pytest.mark.parametrize("whole", [False, True])
def test_files(spark, tmp_path, whole):
    (tmp_path / "a.json").write_text('{"prompt":\n"a"}' if whole else '{"prompt": "a"}\n{"prompt": 1}\n')
    parsed = P.read_prompt_requests(spark, str(tmp_path), whole_files=whole)
    good, bad = P.split_valid(parsed)
    assert [r.prompt for r in good.collect()] == ["a"] and bad.count() == (0 if whole else 1)
