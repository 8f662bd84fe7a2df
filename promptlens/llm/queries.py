"""The operators as queries over the test tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from promptlens.llm import (divergence, exact_dedup, fill_middle, jaccard_join, language_id, licenses, mixing, packing, quality_knn, quality_rules, secrets, toxicity,
                            url_filter)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_words(_table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def document_path() -> Column:
    """A file tree for the documents: source/thousands/hundreds/name, with a licence file in some directories.

    ``documents`` has no paths; this one depends on doc_id and source alone.
    """
    k, source = F.col("doc_id"), F.coalesce("source", F.lit("none"))
    text = lambda c: c.cast("long").cast("string")
    upper, lower = F.floor(k / 6400), F.floor(k / 640)
    return (F.when(F.floor(k / 20) % 320 == 0, F.concat_ws("/", source, text(upper), F.lit("LICENSE.txt")))
            .when(F.floor(k / 20) % 32 == 0, F.concat_ws("/", source, text(upper), text(lower), F.lit("LICENSE.txt")))
            .otherwise(F.concat_ws("/", source, text(upper), text(lower), F.concat(k.cast("string"), F.lit(".txt")))))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _table(spark, sf_dir, "documents").withColumn("path", document_path())
    return licenses.scan_licenses(files)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(_table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_mix, op2_secrets, op3_quality, op4_language, op5_jaccard, op6_packing, op7_url_filter, op8_exact_dedup, op9_quality_rules, op10_licenses,
                                   op11_fill_middle, op12_divergence, op13_toxicity)}

ORACLE = {
    "op1_mix": r"""
with d as (select doc_id, source, case when text is null then 0 else len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) end::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source is null, source) - 1 as src from d group by source),
w as (select *, [3, 1, 2][(src % 3 + 1)::int]::bigint as weight from s),
f as (select *, 3 * sum(source_size) over () as whole,
        4 * coalesce(sum(source_size) over (p rows between unbounded preceding and 1 preceding), 0) as capped,
        sum(weight) over () - coalesce(sum(weight) over (p rows between unbounded preceding and 1 preceding), 0) as rest,
        row_number() over p as n
      from w window p as (order by source_size / weight, src)),
g as (select *, weight * (whole - capped) > 4 * source_size * rest as is_full from f),
o as (select min(n) as n from g where not is_full),
lvl as (select whole - capped as rem, rest from g where n = (select n from o)),
t as (select source, source_size, case when (select n from o) is null or g.n < (select n from o) then (2 * source_size)::double
        else (weight * (select rem from lvl))::double / (2 * (select rest from lvl))::double end as target from g),
p as (select d.doc_id, d.size, t.source_size, t.target,
        coalesce(sum(d.size) over (partition by d.source order by md5(d.doc_id::varchar), d.doc_id rows between unbounded preceding and 1 preceding), 0) as start
      from d join t on d.source is not distinct from t.source),
q as (select *, floor(target + 0.5)::bigint as goal from p)
select doc_id, size, source_size, target,
  (case when source_size = 0 then 0 else size * (goal // source_size)
     + greatest(0, least(start + size, goal % source_size) - start) end)::bigint as taken
from q""",
    "op5_jaccard": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
      from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
        else list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) end as s from w),
c as (select s, min(doc_id) as v, len(s) as n from s where len(s) > 0 group by s),
x as (select v, n, unnest(s) as shingle from c),
p as (select a.v as a, b.v as b, a.n + b.n as sizes, count(*) as common from x a join x b on a.shingle = b.shingle and a.v < b.v group by all),
l as (select a, b from p where 100 * common >= 90 * (sizes - common)),
e as (select a, b from l union all select b, a from l),
r(v, u) as (select a, b from e union select r.v, e.b from r join e on r.u = e.a),
m as (select v, min(u) as u from r group by v)
select doc_id, len(s.s) as n_shingles, least(doc_id, c.v, m.u) as component_id from s left join c on c.s = s.s left join m on m.v = c.v""",
    "op8_exact_dedup": r"""
with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
g as (select t, min(doc_id) as keep_id, count(*) as group_size from n group by t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t) as text_sha256 from n join g using (t)""",
    "op10_licenses": rf"""
with t as (select row_number() over () - 1 as t, c[1] as license, c[2] as text from (select unnest({[list(x) for x in licenses.TEMPLATES]!r}) as c)),
f as (select doc_id, coalesce(text, '') as text,
        case when doc_id // 20 % 320 = 0 then concat_ws('/', coalesce(source, 'none'), doc_id // 6400, 'LICENSE.txt')
             when doc_id // 20 % 32 = 0 then concat_ws('/', coalesce(source, 'none'), doc_id // 6400, doc_id // 640, 'LICENSE.txt')
             else concat_ws('/', coalesce(source, 'none'), doc_id // 6400, doc_id // 640, doc_id || '.txt') end as path
      from documents),
l as (select doc_id, trim(line) as line from (select doc_id, unnest(string_split(text, chr(10))) as line from f) where regexp_matches(line, '{licenses.HEADER}')),
d as (select line, count(*) as n from l group by line),
k as (select line, token, count(*) as tf, max(n) as n from (select line, n, unnest(regexp_extract_all(lower(line), '{licenses.TOKEN}')) as token from d) group by all),
df as (select token, sum(n) as df from k group by token),
lw as (select line, token, tf * (ln(((select sum(n) from d) + 1.0) / (df + 1)) + 1) as w from k join df using (token)),
tw as (select t, license, token, tf * (ln(((select coalesce(sum(n), 0) from d) + 1.0) / (coalesce(df, 0) + 1)) + 1) as w
       from (select t, license, token, count(*) as tf from (select t, license, unnest(regexp_extract_all(lower(text), '{licenses.TOKEN}')) as token from t) group by all)
       left join df using (token)),
c as (select line, t, license, sum(lw.w * tw.w) as dot from lw join tw using (token) group by all),
s as (select line, t, license, round(dot / (select sqrt(sum(w * w)) from lw where lw.line = c.line) / (select sqrt(sum(w * w)) from tw where tw.t = c.t), 6) as score from c),
b as (select line, license, score from s qualify row_number() over (partition by line order by score desc, t) = 1),
o as (select doc_id, max(score) as score, max_by(license, (score, license)) as license from l join b using (line) group by doc_id),
own as (select f.doc_id, path, (select count(*) from l where l.doc_id = f.doc_id) as n_headers, coalesce(score, 0.0)::double as score,
          case when score >= {licenses.THRESHOLD} then license end as own_license, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir
        from f left join o using (doc_id)),
a as (select dir, own_license as license from own where path like '%/LICENSE.txt' and own_license is not null
      qualify row_number() over (partition by dir order by score desc, own_license) = 1),
h as (select own.dir, a.dir as ancestor, a.license from (select distinct dir from own) own join a on starts_with(own.dir || '/', a.dir || '/')
      qualify row_number() over (partition by own.dir order by length(a.dir) desc) = 1)
select doc_id, path, n_headers, score, own_license, coalesce(own_license, h.license) as license,
  case when own_license is null then h.ancestor end as inherited_from
from own left join h using (dir)""",
    "op11_fill_middle": r"""
with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(doc_id::varchar, '')) as h from documents),
h as (select doc_id, t, n, ('0x' || h[1:8])::bigint % (n + 1) as c1, ('0x' || h[9:16])::bigint % (n + 1) as c2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
f as (select doc_id, t, n, least(c1, c2) as a, greatest(c1, c2) as b,
        case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from h),
p as (select *, substr(t, 1, a) as p, substr(t, a + 1, b - a) as m, substr(t, b + 1) as s from f)
select doc_id, n::bigint as n, form, case when form <> 'plain' then a::bigint end as prefix_chars, case when form <> 'plain' then (b - a)::bigint end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then concat('<P>', p, '<S>', s, '<M>', m) else concat('<S>', s, '<P>', p, '<M>', m) end) as output_sha256,
  sha256(t) as restored_sha256 from p""",
    "op12_divergence": r"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as id,
             unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
k as (select lang, term, count(*) as n from d group by all having count(distinct id) >= 3),
c as (select lang, source, term, count(*) as c from d join k using (lang, term) group by all),
v as (select lang, count(*) as v, sum(n) as whole from k group by lang),
o as (select lang, source, sum(c) as own from c group by all),
g as (select distinct coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
p as (select g.lang, g.source, k.term, coalesce(c.c, 0) as c, 1 + 1000000000::hugeint * (coalesce(c.c, 0) + 1) // (coalesce(o.own, 0) + v.v) as p,
        1 + 1000000000::hugeint * (k.n + 1) // (v.whole + v.v) as q
      from g join k using (lang) join v using (lang) left join o on o.lang = g.lang and o.source = g.source left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
s as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
r as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
        left join s on s.lang = a.lang and s.source = a.source and s.item = b.source
      union all select lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint from p where c > 0 and p > q),
n as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from r)
select lang, source, part, item, value, rank from n where part = 'pair' or rank <= 200""",
}
