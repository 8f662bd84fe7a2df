import __spark_entry__ as entry
from conftest_llm import SF_SMALL
from oracle_util import compare, duck

from promptlens.llm import licenses, queries

MIT = "Released under the MIT License."
GPL = "This work is licensed under the GNU General Public License, version 3."


def test_against_sql(spark):
    problems, n = compare(queries.op10_licenses(spark, SF_SMALL), duck(SF_SMALL), entry.oracle_sql()["op10_licenses"])
    assert not problems and n == 1000


def test_nearest_ancestor_directory(spark):
    files = [(1, "LICENSE", MIT), (2, "a/COPYING.md", GPL), (3, "a/b/c/x.py", "code"), (4, "b/x.py", "code"), (5, "a/x.py", f"# {MIT}\ncode"),
             (6, "a/b/LICENSE", "no such words"), (7, "ab/x", "code"), (8, None, "code"), (9, "c/License.txt", "Licensed under CC BY-NC 4.0."), (10, "c/UNLICENSE", GPL), (11, "c/d/e", None)]
    got = {r.doc_id: (r.own_license, r.license, r.inherited_from) for r in licenses.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert got[1] == ("MIT", "MIT", None) and got[2] == ("GPL-3.0", "GPL-3.0", None)
    assert got[3] == (None, "GPL-3.0", "a") and got[4] == (None, "MIT", "") and got[5] == ("MIT", "MIT", None)
    assert got[6] == (None, "GPL-3.0", "a") and got[7] == (None, "MIT", "") and got[8] == (None, None, None)
    assert got[11][2] == "c" and got[11][1] in ("CC-BY-NC-4.0", "GPL-3.0")


def test_prose_about_licences_is_not_one(spark):
    r = licenses.scan_licenses(spark.createDataFrame([(1, "x/y", "He lost his driving licence on the way to the station and never got another one back")], "doc_id long, path string, text string")).first()
    assert r.n_headers == 1 and r.own_license is None and r.license is None


def test_full_texts_wrapped_and_embedded_notices(spark):
    from promptlens.llm.license_texts import FULL_TEXTS
    full = dict(FULL_TEXTS)
    wrap = lambda t, lead="": "\n".join(lead + " ".join(t.split()[i:i + 9]) for i in range(0, len(t.split()), 9))
    filler = "def f(x): return x plus one and so on until the end of days"
    files = [(i, f"whole{i}/LICENSE", f"Copyright (c) 2020 Jane Roe. All rights reserved.\n\n{wrap(text)}") for i, (_, text) in enumerate(FULL_TEXTS)]
    files += [(i + 50, f"whole{i}/src/x.py", filler) for i in range(len(FULL_TEXTS))]
    files += [(100, "a/x.c", "/*\n" + wrap("Copyright (c) 2020. All rights reserved. " + full["BSD-3-Clause"], " * ") + "\n */\n" + filler * 50),
              (101, "a/y.c", "# Licensed under the\n# Apache License,\n# Version 2.0.\n" + filler),
              (102, "a/z.txt", f"{filler} {filler} Released under the MIT License. {filler} {filler}"),
              (103, "a/w.txt", "All rights reserved.\n" + filler),
              (104, "a/LICENSE", f"{filler} " * 40),
              (105, "a/v.txt", f"{filler} the domain of the reserved licence and the copyright of commons in a file {filler}")]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert {n: got[i].own_license for i, (n, _) in enumerate(FULL_TEXTS)} == {n: n for n, _ in FULL_TEXTS}
    assert all(got[i + 50].license == n and got[i + 50].inherited_from == f"whole{i}" for i, (n, _) in enumerate(FULL_TEXTS))
    assert (got[100].own_license, got[101].own_license, got[102].own_license) == ("BSD-3-Clause", "Apache-2.0", "MIT")
    assert got[103].own_license == "Proprietary" and got[104].own_license is None and got[105].own_license is None
    assert got[102].score == 1.0


def brute(files, templates=licenses.TEMPLATES, full=None):
    """{doc_id: (own_license, score)} of (doc_id, path, text), with vectors in plain dictionaries."""
    import math
    import re
    from collections import Counter

    from promptlens.llm.license_texts import FULL_TEXTS
    full = FULL_TEXTS if full is None else full
    tokens = lambda t: re.findall(licenses.TOKEN, t.translate({i: i + 32 for i in range(65, 91)}))
    headers = {i: [x.strip(" ") for x in (t or "").split("\n") if re.search(licenses.HEADER, x)] for i, _, t in files}
    df, total = Counter(), 0
    for found in headers.values():
        for h in found:
            df.update(set(tokens(h)))
            total += 1
    idf = lambda x: math.log((total + 1) / (df[x] + 1)) + 1
    vector = lambda words, tf=lambda n: n: {w: tf(n) * idf(w) for w, n in Counter(words).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    cos = lambda u, v: round(sum(x * v.get(w, 0) for w, x in u.items()) / (norm(u) * norm(v)), 6) if u and v else 0
    notes = [(name, tokens(t), vector(tokens(t))) for name, t in templates]
    texts = [(name, tokens(t), vector(tokens(t), lambda n: 1 + math.log(n))) for name, t in full]
    out = {}
    for i, path, text in files:
        words, best, named, whole = tokens(text or ""), [], [], []
        for h in headers[i]:
            if tokens(h):
                best.append(max(((cos(vector(tokens(h)), v), -k, n) for k, (n, _, v) in enumerate(notes) if cos(vector(tokens(h)), v) > 0), default=None))
        best = [(b[0], b[2]) for b in best if b]
        for name, own, v in notes:
            for at in range(len(words) - len(own) + 1):
                w = words[at:at + len(own)]
                if w[0] in v and any(re.search(licenses.KEY, x) for x in w) and (c := cos(vector(w), v)) >= licenses.WINDOW_THRESHOLD:
                    best.append((c, name))
                    named += [(c, name)] * (name != licenses.RESERVED)
        base = (path or "").rsplit("/", 1)[-1].lower().rsplit(".", 1)[0]
        stretches = [words] if base in licenses.LICENSE_FILES else []
        for _, own, _ in texts:
            stretches += [words[at:at + len(own)] for at in range(len(words)) if words[at:at + licenses.OPENING] == own[:licenses.OPENING]]
        for x in {tuple(x) for x in stretches}:
            near = [(cos(vector(x, lambda n: 1 + math.log(n)), v), -k, name) for k, (name, _, v) in enumerate(texts)]
            whole += [(c, name) for c, _, name in [max(near)] if c >= licenses.TEXT_THRESHOLD]
        take = max(whole) if whole else max(best, default=(0.0, None))
        if not whole and take[1] == licenses.RESERVED and named:
            take = max(named)
        out[i] = (take[1] if take[0] >= licenses.THRESHOLD else None, take[0])
    return out


def test_windows_and_full_texts_against_plain_vectors(spark):
    import numpy as np

    from promptlens.llm.license_texts import FULL_TEXTS
    rng = np.random.default_rng(9)
    short = [x for x in FULL_TEXTS if len(x[1]) < 2500]
    filler = [f"w{i}" for i in range(30)] + ["the", "license", "copyright", "public", "domain", "version", "of", "reserved", "rights"]
    files = []
    for i in range(90):
        words = list(rng.choice(filler, int(rng.integers(5, 260))))
        for _ in range(rng.integers(0, 3)):
            note = licenses.TEMPLATES[rng.integers(len(licenses.TEMPLATES))][1].split()
            if rng.random() < .5:
                note[rng.integers(len(note))] = "other"
            at = int(rng.integers(len(words) + 1))
            words[at:at] = note
        if i % 6 == 0:
            text = short[rng.integers(len(short))][1].split()
            for _ in range(rng.integers(0, 25)):
                text[rng.integers(6, len(text))] = "changed"
            at = int(rng.integers(len(words) + 1))
            words[at:at] = text
        files.append((i, f"d{i}/LICENSE.md" if i % 5 == 0 else f"d{i}/x", "".join(w + (" " if rng.random() < .9 else "\n") for w in words)))
    got = {r.doc_id: (r.own_license, r.score) for r in licenses.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string").repartition(4), full=short).collect()}
    want = brute(files, full=short)
    assert {k: (a, round(s, 4)) for k, (a, s) in got.items()} == {k: (a, round(s, 4)) for k, (a, s) in want.items()}
    assert len({a for a, _ in want.values()}) > 6


def test_long_texts_of_keywords_and_openings(spark):
    """Half a megabyte of one keyword, and thousands of openings, are cut into pieces: work grows with the text, not with its square."""
    from promptlens.llm.license_texts import FULL_TEXTS
    isc = dict(FULL_TEXTS)["ISC"]
    files = [(1, "a/x", "license " * 60_000), (2, "a/y", f"{' '.join(licenses._words_of(isc)[:licenses.OPENING])} x " * 3000 + isc), (3, "a/z", "license " * 5000 + "\n" + MIT)]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert got[1].own_license is None and got[2].own_license == "ISC" and got[3].own_license == "MIT"
