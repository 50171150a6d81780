"""Registered queries ``opN_<name>`` with their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tmaps.llm import bpe, divergence, exact_dedup, extraction, language, line_dedup, merkle, mtree, ngram_join, packing, quality, toxicity, url_filter
from tmaps.llm.common import table


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


# fixed values of the query: (host, path, verdict)
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return mtree.search(vectors, vectors.where("vec_id % 100 = 0"))


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The site of a document is its source; its lines end at line feeds."""
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents"), "doc_id", "source", "text")


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(merkle.manifest(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_html_extraction": _op1,
    "op2_exact_dedup": _op2,
    "op3_url_filter": _op3,
    "op4_language_id": _op4,
    "op5_mtree_search": _op5,
    "op6_bpe": _op6,
    "op7_ngram_jaccard_join": _op7,
    "op8_line_dedup": _op8,
    "op9_best_fit_packing": _op9,
    "op10_toxicity": _op10,
    "op11_quality_classifier": _op11,
    "op12_source_divergence": _op12,
    "op13_merkle_manifest": _op13,
}

SQL = {
    "op5_mtree_search": """
with t as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
s as (select q.vec_id as query_id, c.vec_id,
             list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
      from t q join t c on q.vec_id % 100 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10""",
    "op2_exact_dedup": r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = min(doc_id) over w as kept, sha256(norm) as text_sha256
from t window w as (partition by norm)""",
    "op8_line_dedup": """
with p as (select doc_id, source, case when coalesce(text, '') = '' then []::varchar[] else string_split(text, chr(10)) end as lines,
                  row_number() over () as page from documents),
t as (select source, count(*) as pages from p group by source),
l as (select page, source, unnest(range(1, len(lines) + 1)) as pos, unnest(lines) as line from p),
c as (select source, trim(line, ' ') as line, count(distinct page) as n from l where trim(line, ' ') <> '' group by all),
d as (select c.source, c.line from c join t on c.source is not distinct from t.source where n >= 3 and n > 0.3 * pages),
k as (select l.page, string_agg(l.line, chr(10) order by pos) as text, count(*) as kept
      from l left join d on l.source is not distinct from d.source and trim(l.line, ' ') = d.line
      where d.line is null group by l.page)
select p.doc_id, p.source, coalesce(k.text, '') as text, len(p.lines) as n_lines, len(p.lines) - coalesce(k.kept, 0) as n_dropped
from p left join k using (page)""",
    "op12_source_divergence": r"""
with d as (select row_number() over () as rid, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
w as (select rid, lang, source, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term from w group by all having count(distinct rid) >= 30),
v as (select lang, count(*) as v from kept group by all),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from w semi join kept using (lang, term) group by all),
ng as (select lang, source, sum(n) as n_all from c group by all),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
             1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (coalesce(ng.n_all, 0) + 5 * v.v) as p
      from g join kept k using (lang) join v using (lang) left join c using (lang, source, term) left join ng using (lang, source)),
q as (select lang, term, 1 + (1000000000::hugeint * (sum(n) + 5)) // (sum(sum(n)) over (partition by lang) + 5 * any_value(v.v)) as q
      from c join v using (lang) group by lang, term),
t as (select p.lang, p.source, 'term' as part, p.term as item, (p.p - q.q)::bigint as value from p join q using (lang, term) where p.n > 0 and p.p > q.q),
f as (select a.lang, a.source, b.source as other, sum(abs(a.p - b.p))::bigint as f
      from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
x as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.f, 0) as value
      from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.other = b.source),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from t union all select * from x))
select lang, source, part, item, value, rank from r where part = 'pair' or rank <= 50""",
    "op13_merkle_manifest": """
with recursive d as (
  select row_number() over () as rid, doc_id, text, coalesce('=' || source, '') as tree,
         concat(coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-')) as head,
         list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::varchar, ''), lambda x: [ascii(x), 0, 0, 0, 0, 0, 0, 0]))::bigint[]),
                     lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))) as crc
  from documents),
l as (
  select *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
         case when xor(crc, 4294967295) % 2 = 0
              then sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) end as tampered from d),
p as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf, rid) - 1 as i, count(*) over (partition by tree) as n from l),
node as (
  select tree, 0 as lvl, i, leaf as h, n from p
  union all
  select tree, lvl + 1, i // 3, sha256(string_agg(h, '' order by i)), (n + 2) // 3 from node where n > 1 group by tree, lvl, i // 3, n),
runs as (select tree, lvl, i // 3 as g, list(h order by i) as hs from node where n > 1 group by all),
subs as (select tree, h as subroot, row_number() over (order by tree) - 1 as i, count(*) over () as n from node where n = 1),
up as (
  select 0 as lvl, i, subroot as h, n from subs
  union all
  select lvl + 1, i // 3, sha256(string_agg(h, '' order by i)), (n + 2) // 3 from up where n > 1 group by lvl, i // 3, n),
tops as (select lvl, i // 3 as g, list(h order by i) as hs from up where n > 1 group by all),
fold as (
  select rid, tree, 0 as lvl, i, coalesce(tampered, leaf) as h, '' as proof from p
  union all
  select f.rid, f.tree, f.lvl + 1, f.i // 3, sha256(array_to_string(hs[:f.i % 3], '') || f.h || array_to_string(hs[f.i % 3 + 2:], '')),
         f.proof || array_to_string(hs[:f.i % 3], '') || array_to_string(hs[f.i % 3 + 2:], '')
  from fold f join runs r on r.tree = f.tree and r.lvl = f.lvl and r.g = f.i // 3),
rest as (
  select f.rid, 0 as lvl, s.i, arg_max(f.h, f.lvl) as h, arg_max(f.proof, f.lvl) as proof from fold f join subs s using (tree) group by f.rid, s.i
  union all
  select f.rid, f.lvl + 1, f.i // 3, sha256(array_to_string(hs[:f.i % 3], '') || f.h || array_to_string(hs[f.i % 3 + 2:], '')),
         f.proof || array_to_string(hs[:f.i % 3], '') || array_to_string(hs[f.i % 3 + 2:], '')
  from rest f join tops t on t.lvl = f.lvl and t.g = f.i // 3),
ends as (select rid, arg_max(h, lvl) as folded_root, sha256(arg_max(proof, lvl)) as proof_sha256 from rest group by rid)
select p.doc_id, p.leaf, s.subroot, (select h from up where n = 1) as root, e.proof_sha256, e.folded_root,
       e.folded_root = (select h from up where n = 1) as verified
from p join subs s using (tree) join ends e using (rid)""",
}
