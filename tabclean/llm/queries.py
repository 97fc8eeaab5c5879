"""Registered queries of this subpackage and the SQL that some can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabclean.llm import ann, common, exact_dedup, langid, merkle, ngram_lm, packing, phrases, records, ring, secret_scan, simhash, sp_bpe, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    common.prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(_table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(_table(spark, sf_dir, "documents"), common.remainder_of_id("doc_id", 7) == 2)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, distance=4)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = common.remainder_of_id("doc_id", 3) == 1
    model = langid.fit(docs, ~held_out)
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = records.write_records(_table(spark, sf_dir, "documents"), common.vocabulary("byte_bpe_50k.json"), end_id=2, special=True)
    return records.read_back(manifest)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.assign(_table(spark, sf_dir, "documents"), shards=8)


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = common.remainder_of_id("doc_id", 5) == 0
    scorer = toxicity.fit(docs, _table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, scorer).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_bpe.digests(_table(spark, sf_dir, "documents"), common.vocabulary("piece_bpe_32k.model"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), common.vocabulary("word_bpe_49k.json"), length=2048, end_id=1, special=True)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = common.remainder_of_id("doc_id", 7) == 0
    return merkle.digests(_table(spark, sf_dir, "documents"), {"n_chars": F.when(tampered, F.try_add("n_chars", F.lit(1))).otherwise(F.col("n_chars"))})


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"), least=30, top=2000, share=80)


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_simhash": op3_simhash,
    "op4_language": op4_language,
    "op5_token_records": op5_token_records,
    "op6_sharding": op6_sharding,
    "op7_nearest": op7_nearest,
    "op8_toxicity": op8_toxicity,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_packing": op10_packing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_phrases": op12_phrases,
    "op13_secret_scan": op13_secret_scan,
}

def _encoded(n_chars: str) -> str:
    """The fields of a Merkle leaf in DuckDB SQL, with another expression for ``n_chars``."""
    fields = ["doc_id", "source", "lang", n_chars, "text"]
    return " || ".join(f"coalesce(strlen(({f})::varchar)::varchar || ':' || ({f})::varchar, '-')" for f in fields)


# DuckDB has no crc32: a byte is mixed in, then eight times the register is shifted and reduced.
_crc32_of_id = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(coalesce(doc_id::varchar, ''), ''),
  lambda c: case when c = '' then [] else list_concat([ascii(c)::bigint], [-1, -1, -1, -1, -1, -1, -1, -1]) end))),
  lambda crc, x: case when x >= 0 then xor(crc, x) else xor(crc >> 1, 3988292384 * (crc & 1)) end), 4294967295)"""

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": r"""
with d as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256
  from documents)
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size,
  doc_id = min(doc_id) over g as kept, text_sha256
from d window g as (partition by text_sha256)
""",
    "op11_merkle_manifest": rf"""
with recursive d as (
  select doc_id, lang, sha256({_encoded("n_chars")}) as leaf, sha256({_encoded(f"case when {_crc32_of_id} % 7 = 0 then n_chars + 1 else n_chars end")}) as other,
    row_number() over (partition by lang order by doc_id nulls first, sha256({_encoded("n_chars")})) - 1 as r
  from documents),
tree(lang, lvl, i, h) as (
  select lang, 0::bigint, r, leaf from d
  union all
  select lang, lvl + 1, i // 2, sha256(string_agg(h, '' order by i))
  from (select *, max(i) over (partition by lang) as last_i from tree) where last_i > 0 group by lang, lvl, i // 2),
height as (select lang, max(lvl) as lvls from tree group by lang),
sub as (
  select lang, h as subroot, row_number() over (order by lang nulls first) - 1 as s
  from (select t.lang, t.h from tree t join height g on t.lang is not distinct from g.lang and t.lvl = g.lvls)),
top(lvl, i, h) as (
  select 0::bigint, s, subroot from sub
  union all
  select lvl + 1, i // 2, sha256(string_agg(h, '' order by i)) from (select *, max(i) over () as last_i from top) where last_i > 0 group by lvl, i // 2),
root as (select h as root, lvl as lvls from top where lvl = (select max(lvl) from top)),
siblings as (
  select d.lang, d.r, g.lvl, d.r >> g.lvl as place, t.h
  from d join (select distinct t.lang, t.lvl from tree t join height g on t.lang is not distinct from g.lang and t.lvl < g.lvls) g on d.lang is not distinct from g.lang
  left join tree t on t.lang is not distinct from d.lang and t.lvl = g.lvl and t.i = xor(d.r >> g.lvl, 1)
  union all
  select d.lang, d.r, 1000 + g.lvl, sub.s >> g.lvl, t.h
  from d join sub on d.lang is not distinct from sub.lang join (select distinct lvl from top where lvl < (select lvls from root)) g on true
  left join top t on t.lvl = g.lvl and t.i = xor(sub.s >> g.lvl, 1)),
steps as (
  select lang, r, row_number() over (partition by lang, r order by lvl) as step,
    case when place % 2 = 1 then coalesce(h, '') else '' end as lh, case when place % 2 = 0 then coalesce(h, '') else '' end as rh
  from siblings),
proof as (select lang, r, sha256(coalesce(string_agg(lh || rh, '' order by step), '')) as proof_sha256, count(*) as n from steps group by lang, r),
fold(lang, r, step, h) as (
  select lang, r, 0::bigint, other from d
  union all
  select f.lang, f.r, f.step + 1, sha256(s.lh || f.h || s.rh) from fold f join steps s on f.lang is not distinct from s.lang and f.r = s.r and s.step = f.step + 1)
select d.doc_id, d.leaf, sub.subroot, root.root, coalesce(p.proof_sha256, sha256('')) as proof_sha256, f.h as folded_root, f.h = root.root as verified
from d join sub on d.lang is not distinct from sub.lang join root on true
left join proof p on p.lang is not distinct from d.lang and p.r = d.r
join fold f on f.lang is not distinct from d.lang and f.r = d.r and f.step = coalesce(p.n, 0)
""",
    "op12_phrases": r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
listed as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
grams as (
  select lang, k, array_to_string(w[p:p + k - 1], ' ') as phrase, count(*) as c
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as p from listed, (values (1), (2), (3), (4)) as sizes(k) where len(w) >= k)
  group by lang, k, phrase),
totals as (select lang, sum(c)::bigint as n from grams where k = 1 group by lang),
frequent as (select * from grams where c >= 30),
cuts as (
  select f.lang, f.k, f.phrase, f.c as a, cut, l.c as l, r.c as r, ((2000000::hugeint * f.c) // (l.c + r.c))::bigint as score
  from (select *, string_split(phrase, ' ') as w, unnest(range(1, k)) as cut from frequent where k > 1) f
  join frequent l on l.lang = f.lang and l.phrase = array_to_string(f.w[1:cut], ' ')
  join frequent r on r.lang = f.lang and r.phrase = array_to_string(f.w[cut + 1:f.k], ' ')),
best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
longer as (
  select lang, array_to_string(w[p:p + m - 1], ' ') as phrase, max(c) as most
  from (select lang, c, w, m, unnest(range(1, k - m + 2)) as p from (select *, string_split(phrase, ' ') as w from frequent where k > 2), (values (2), (3)) as sizes(m) where m < k)
  group by lang, 2),
kept as (select b.* from best b left join longer g using (lang, phrase) where g.most is null or 100 * g.most < 80 * b.a)
select kept.lang, row_number() over (partition by kept.lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from kept join totals using (lang)
qualify rank <= 2000
""",
}

# Sums of doubles: equal but for the last digits, which follow the order of the terms. Tests compare them within 1e-9.
NEAR_SQL: dict[str, str] = {
    "op2_lm_scoring": rf"""
with d as (
  select doc_id, ({_crc32_of_id}) % 7 = 2 as held_out,
    list_concat(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), [chr(10)]) as w
  from documents),
t as (select doc_id, held_out, p, w[p] as w1, case when p > 1 then w[p - 1] else '' end as w2, case when p > 2 then w[p - 2] when p = 2 then '' end as w3
  from (select *, unnest(range(1, len(w) + 1)) as p from d)),
ones as (select w1, count(*) as c from t where not held_out group by w1),
twos as (select w2, w1, count(*) as c from t where not held_out group by w2, w1),
threes as (select w3, w2, w1, count(*) as c from t where not held_out and w3 is not null group by w3, w2, w1),
totals as (select coalesce(sum(c), 0)::bigint as n, count(*) as v, (select count(*) from d where not held_out) as texts from ones),
counted as (
  select t.doc_id, t.held_out, n, v, coalesce(ones.c, 0) as c1, coalesce(twos.c, 0) as c2, coalesce(threes.c, 0) as c3,
    case when t.w2 = '' then texts else coalesce(before.c, 0) end as h1, case when t.w3 is null then 0 else coalesce(pair.c, 0) end as h2
  from t cross join totals
  left join ones on t.w1 = ones.w1
  left join ones before on t.w2 = before.w1
  left join twos on t.w2 = twos.w2 and t.w1 = twos.w1
  left join twos pair on t.w3 = pair.w2 and t.w2 = pair.w1
  left join threes on t.w3 = threes.w3 and t.w2 = threes.w2 and t.w1 = threes.w1),
one as (select *, (c1 + 1.0::double) / (n + v + 1) as p1, {ngram_lm.TOP}::double * h1 / (h1 + {ngram_lm.HALF}::double) as s1, {ngram_lm.TOP}::double * h2 / (h2 + {ngram_lm.HALF}::double) as s2 from counted),
two as (select *, case when h1 > 0 then s1 * c2 / h1 else 0 end + (1 - s1) * p1 as p2 from one),
three as (select *, case when h2 > 0 then s2 * c3 / h2 else 0 end + (1 - s2) * p2 as p3 from two)
select doc_id, held_out, count(*) as n_tokens, count(*) filter (where c1 > 0) as n_known, any_value(n) as train_tokens,
  sum(log10(p1)) as base_score, sum(log10(p3)) as score
from three group by doc_id, held_out
""",
    "op7_nearest": """
with e as (
  select vec_id, embedding::double[] as x from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0
    and len(list_filter(embedding, lambda y: y <> 0)) > 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.x, c.x) as score
  from e q join e c on len(q.x) = len(c.x) and q.vec_id <> c.vec_id where q.vec_id % 20 = 0)
select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score
from scored qualify rank <= 20
""",
}
