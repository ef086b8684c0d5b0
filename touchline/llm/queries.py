"""The registered queries of this package and, where SQL can express them, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from touchline.llm import (
    chat_format, code_compression, decontamination, embedding_dedup, license_scan, minhash_dedup, mixing, pii, prefix_trie, quality, secret_scan, sharding, url_filter,
)
from touchline.session import prepare

QueryFunction = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.verdicts(table(spark, sf_dir, "pages"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op4_subspace_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), mixing.Target(max_repeats=1.25))


def op8_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op9_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(table(spark, sf_dir, "conversations"))


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With one more conversation, -1, whose texts consist of the template's own marks."""
    marks = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).selectExpr("-1L as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", f"'{marks}' as text")
    return chat_format.report(rows.unionByName(probe))


def op13_member_resident_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_compression.codes(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, QueryFunction] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_benchmark_decontamination, op3_secret_scan, op4_subspace_pigeonhole, op5_temperature_mixing,
        op6_url_filter, op7_minhash_near_dedup, op8_pii_crf, op9_sampled_splitters, op10_quality_classifier,
        op11_conversation_prefix_trie, op12_chat_formatting, op13_member_resident_lloyd,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL: dict[str, str] = {
    "op4_subspace_pigeonhole": """
with recursive v as (
  select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
),
ok as (
  select r, vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from v
  where label is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0
),
linked as (
  select a.r as x, b.r as y from ok a join ok b on a.label = b.label and a.r <> b.r and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
),
n as (select x, count(*) as n_links from linked group by x),
reach as (select r, r as other from v union select p.r, l.y from reach p join linked l on l.x = p.other),
c as (select reach.r, min(v.vec_id) as component_id from reach join v on v.r = reach.other group by reach.r)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept
from v join c using (r) left join n on n.x = v.r
""",
    "op5_temperature_mixing": r"""
with recursive d as (
  select doc_id, coalesce(source, '') as source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as tokens from documents
),
s as (select source, sum(tokens)::bigint as t, count(*) as n, (sum(sum(tokens)) over ())::bigint as total from d group by source),
bisect as (
  select 0 as step, 0.0::double as low, 1.0::double as high
  union all
  select step + 1,
    case when ok then low else (low + high) / 2 end, case when ok then (low + high) / 2 else high end
  from (
    select step, low, high, (
      select max(pow(t, (low + high) / 2) / z * total / t) <= 1.25
      from s, (select sum(pow(t, (low + high) / 2)) as z from s where t > 0) where t > 0
    ) as ok
    from bisect where step < 32
  )
),
e as (
  select case when (select max(1.0 / m * total / t) <= 1.25 from s, (select count(*) as m from s where t > 0) where t > 0) then 0.0
    else least(1.0, (floor(high * 1000000) + 1) / 1000000) end as a
  from bisect where step = 32
),
w as (select source, t, n, total, case when t > 0 then pow(t::double / total, a) else 0 end as raw from s, e),
p as (select *, cast(floor(round(raw / sum(raw) over () * total, 6)) as bigint) as budget, cast(ceil(sqrt(n)) as bigint) as n_blocks from w),
q as (select *, case when t > 0 then budget // t else 0 end as passes from p),
k as (
  select d.*, passes, budget - passes * t as rest, md5(coalesce(cast(doc_id as varchar), '')) as dk,
    (cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) * n_blocks) >> 32 as block
  from d join q using (source)
),
o as (select *, sum(tokens) over (partition by source order by md5(source || '|' || block), dk, doc_id) as upto from k)
select doc_id, source, tokens, block, cast(passes + case when rest is not null and upto <= rest then 1 else 0 end as bigint) as copies from o
""",
    "op2_benchmark_decontamination": f"""
with d as (select doc_id, {_WORDS} as w from documents),
dw as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos, len(w) as n_words from d),
b as (select cast(item_id as varchar) as item_id, {_WORDS} as w from benchmark),
win as (
  select distinct item_id, least(len(w), 13) as n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') as s
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0)
),
sizes as (select distinct n from win),
dwin as (
  select doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') as s
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)
),
hit as (select doc_id, i, n, item_id from dwin join win using (n, s)),
words_hit as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from hit)) group by doc_id
),
items as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from hit) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from d left join words_hit using (doc_id) left join items using (doc_id)
""",
    "op7_minhash_near_dedup": rf"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from documents),
sh as (
  select distinct doc_id, array_to_string(w[i : i + 2], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from d where len(w) > 0)
),
n as (select doc_id, count(*) as n_shingles from sh group by doc_id),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as both_have from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by all),
linked as (
  select x, y from pairs join n p on p.doc_id = x join n q on q.doc_id = y
  where 100 * both_have >= 85 * (p.n_shingles + q.n_shingles - both_have)
),
edges as (select x, y from linked union all select y, x from linked),
reach as (
  select doc_id, doc_id as other from d union select r.doc_id, e.y from reach r join edges e on e.x = r.other
),
c as (select doc_id, min(other) as component_id from reach group by doc_id)
select d.doc_id, coalesce(n_shingles, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from d join c using (doc_id) left join n using (doc_id)
""",
}

_MARK = r"([<\[])(\\*)(<SYS>>|</SYS>>|INST\]|/INST\]|s>|/s>|ROLE\]|TEXT\]|/ROLE\])"


def _escaped_length(column: str) -> str:
    return rf"length(regexp_replace({column}, '{_MARK}', '\1\2\\\3', 'g'))"


#: CRC-32 of a number's decimal digits, bit by bit.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(conv_id as varchar), ''), lambda x: ascii(x)::bigint)),
    lambda v, x: list_reduce(list_prepend(xor(v, x), range(8)), lambda y, i: xor(y >> 1, (y & 1) * 3988292384::bigint))), 4294967295::bigint)"""

SQL["op11_conversation_prefix_trie"] = f"""
with turns as (
  select conv_id, coalesce(role, '') as role, sha256(coalesce(text, '')) as t, length(coalesce(text, ''))::bigint as chars,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(coalesce(text, ''))) as n
  from conversations where conv_id is not null
),
sizes as (select conv_id, count(*) as n, conv_id - conv_id % 100 as base, {_CRC32} % 6 as h from turns group by conv_id),
known as (select s.conv_id, s.base, s.h, s.n, least(s.h, coalesce(b.n, 0)) as lent from sizes s left join sizes b on b.conv_id = s.base),
rebuilt as (
  select conv_id, t.n - h + lent as pos, lent + n_all - h as len, role, t, chars from (select turns.*, known.n as n_all, h, lent from turns join known using (conv_id)) t where t.n > h
  union all
  select k.conv_id, t.n, k.lent + greatest(k.n - k.h, 0), role, t, chars from known k join turns t on t.conv_id = k.base and t.n <= k.lent
),
prefix as (
  select conv_id, pos, len, chars, sha256(string_agg(length(role) || ':' || role || t, '|') over (partition by conv_id order by pos)) as k from rebuilt
  union all
  select conv_id, 0, lent + greatest(n - h, 0), 0, '' from known
),
linked as (select *, lag(k) over (partition by conv_id order by pos) as pk from prefix),
node as (
  select pos, k, min(pk) as pk, min(conv_id) as conv_id, count(*) as n, max(chars) as chars,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (pos = len), '')) as ends_sha256
  from linked group by pos, k
),
kids as (select pos - 1 as pos, pk as k, count(*) as n_children from node where pos > 0 group by all),
node2 as (select node.*, coalesce(n_children, 0) as n_children from node left join kids using (pos, k)),
below as (
  select p.pos, p.k, sum((y.n_children = 0)::bigint)::bigint as n_leaves, sum((y.n - 1) * y.chars)::bigint as saved_tokens
  from node2 y join prefix p on p.conv_id = y.conv_id and p.pos <= y.pos group by p.pos, p.k
)
select x.conv_id, x.pos::bigint as depth, up.conv_id as parent_conv_id, x.n as n_convs, x.n_children, n_leaves, saved_tokens, x.ends_sha256
from node2 x join below using (pos, k) left join node2 up on up.pos = x.pos - 1 and up.k = x.pk
"""

SQL["op12_chat_formatting"] = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all
  select -1, v.turn, v.role, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) v(turn, role)
),
piece as (
  select *, row_number() over w as n, count(*) over (partition by conv_id) as last,
    {_escaped_length("text")} + case role when 'system' then 15 when 'user' then 13 when 'assistant' then 7 else 19 + {_escaped_length("role")} end as size
  from turns window w as (partition by conv_id order by turn nulls first, role, text)
),
upto as (select *, sum(size) over (partition by conv_id order by n) as chars from piece)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
  length(coalesce(string_agg(text, '' order by n) filter (role = 'assistant'), ''))::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by n) filter (role = 'assistant'), '')) as loss_sha256,
  (sum(chars) filter (role = 'assistant' or n = last))::bigint as formatted_chars
from upto group by conv_id
"""


def _lloyd_sql(rounds: int = code_compression.ROUNDS) -> str:
    """The rounds written one after the other; dot products of integers are exact in doubles."""

    def nearest(k: int) -> str:
        return f"""
a{k} as materialized (
  select r, p, arg_min(e, d * 256 + e) as e, min(d) as d
  from (select r, parts.p, e, x2 + y2 - 2 * list_dot_product(x, y) as d from parts join b{k} using (p)) group by r, p
)"""

    steps = [nearest(0)]
    for k in range(1, rounds + 1):
        steps.append(f"""
m{k} as (
  select p, e, list(v order by i) as y
  from (
    select p, e, i, floor(sum(v) / count(*)) as v from (select p, e, unnest(x) as v, generate_subscripts(x, 1) as i from a{k - 1} join parts using (r, p)) group by p, e, i
  ) group by p, e
),
b{k} as materialized (
  select p, e, y, list_dot_product(y, y) as y2 from (select b.p, b.e, coalesce(m.y, b.y) as y from b{k - 1} b left join m{k} m using (p, e))
)""")
        steps.append(nearest(k))
    return f"""
with kept as (
  select row_number() over (order by vec_id nulls last) as r, vec_id, label, list_transform(embedding, lambda x: floor(x::double * 1024)) as x
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
parts as materialized (
  select r, p, x, list_dot_product(x, x) as x2 from (select r, p, x[p * len(x) // 4 + 1 : (p + 1) * len(x) // 4] as x from kept, range(4) t(p))
),
b0 as materialized (select p, r - 1 as e, x as y, x2 as y2 from parts where r <= 256),
{",".join(steps)},
sha as (select sha256(string_agg(array_to_string(list_transform(y, lambda v: cast(v::bigint as varchar)), ','), ',' order by p, e)) as codebooks_sha256 from b{rounds}),
coded as (select r, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' order by p) as code, sum(d)::bigint as error from a{rounds} group by r)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from kept join coded using (r), sha
"""


SQL["op13_member_resident_lloyd"] = _lloyd_sql()
