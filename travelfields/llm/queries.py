"""One query for each operator of this package, over whole tables, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from travelfields.llm import chat, embedding_dedup, fingerprints, lattice_lm, maxscore_search, mixing, ngram_join, packing, ppm_language, prefix_trie, quality, sharding, suffix_dedup
from travelfields.llm.text import word_array

LM_VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PACK_TOKENIZER = "word_bpe_49k.json"
SHARDS = [f"shard-{k:03d}" for k in range(64)]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % 10 == 0


def n_words(text: str = "text") -> Column:
    return F.size(word_array(F.col(text))).cast("long")


def good_labels(labels: DataFrame) -> DataFrame:
    """Good: quality 1 and not toxic. A row without a quality is no label."""
    good = (F.col("quality") == 1) & ~(F.coalesce("toxic", F.lit(0)) == 1)
    return labels.select("doc_id", good.alias("good"))


def op1_embedding_near_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_lattice_scoring(spark, sf_dir):
    return lattice_lm.score_documents(_table(spark, sf_dir, "documents"), tokenizer_path(LM_VOCABULARY), held_out())


def op3_perspective_rotation(spark, sf_dir):
    out = chat.rotate_perspectives(_table(spark, sf_dir, "conversations"))
    span = F.transform("train_spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string")))
    return out.withColumn("train_spans", F.array_join(span, " "))


def op4_suffix_array_dedup(spark, sf_dir):
    out = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("left", 256).alias("kept_sha256"))


def op5_entropy_balancing(spark, sf_dir):
    out = mixing.mix(_table(spark, sf_dir, "documents"), n_words())
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_quality_classifier(spark, sf_dir):
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return quality.classify(docs, good_labels(labels), F.col("source"), F.col("lang"), F.col("doc_id"))


def op7_online_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(PACK_TOKENIZER))


def op8_lookup_table_sharding(spark, sf_dir):
    out = sharding.place(_table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"), SHARDS)
    return out.select("doc_id", "shard_slot", "shard")


def op9_canonical_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_with_edits(_table(spark, sf_dir, "documents"))


def op10_signature_tree_join(spark, sf_dir):
    return ngram_join.jaccard_groups(_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.shared_head_trie(_table(spark, sf_dir, "conversations"))


def op12_maxscore_search(spark, sf_dir):
    return maxscore_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_ppm_language(spark, sf_dir):
    id_text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return ppm_language.identify(_table(spark, sf_dir, "documents"), F.crc32(id_text.cast("binary")) % 3 == 1)


def queries():
    ops = (
        op1_embedding_near_dedup, op2_lattice_scoring, op3_perspective_rotation, op4_suffix_array_dedup, op5_entropy_balancing, op6_quality_classifier,
        op7_online_packing, op8_lookup_table_sharding, op9_canonical_fingerprints, op10_signature_tree_join, op11_prefix_trie, op12_maxscore_search, op13_ppm_language,
    )
    return {f.__name__: f for f in ops}


_OP1 = f"""
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
), l as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= {embedding_dedup.THRESHOLD}
), r(vec_id, c) as (
  select vec_id, vec_id from v union select r.vec_id, l.b from r join l on l.a = r.c
)
select v.vec_id, coalesce(n, 0)::bigint as n_links, m as component_id, v.vec_id = m as kept
from v left join (select a, count(*) as n from l group by a) k on k.a = v.vec_id
join (select vec_id, min(c) as m from r group by vec_id) x on x.vec_id = v.vec_id
"""

_OP3 = """
with m as (
  select distinct conv_id, turn, coalesce(role, 'unknown') as speaker, coalesce(text, '') as text from conversations
), p as (
  select distinct conv_id, speaker as perspective from m where speaker <> 'system'
), x as (
  select m.conv_id, perspective, turn, speaker, text, speaker = perspective as own,
    case when speaker = perspective then '<|assistant|>' || chr(10) when speaker = 'system' then '<|system|>' || chr(10)
         else '<|user name=' || speaker || '|>' || chr(10) end as head,
    text || '<|end|>' || chr(10) as body
  from m join p on m.conv_id = p.conv_id
), y as (
  select *, sum(length(head) + length(body)) over (partition by conv_id, perspective order by turn nulls first, speaker, text) as till from x
)
select conv_id, perspective, 0::bigint as block, 0::bigint as first_message, count(*)::bigint as n_messages,
  string_agg(head || body, '' order by turn nulls first, speaker, text) as rendered,
  string_agg(case when own then '1' else '0' end, '' order by turn nulls first, speaker, text) as mask,
  coalesce(string_agg(case when own then (till - length(body))::bigint || '-' || till::bigint end, ' ' order by turn nulls first, speaker, text), '') as train_spans
from y group by conv_id, perspective
"""

_OP10 = f"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') as ws from documents
), g as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end as gs from w
), s as (
  select doc_id, len(gs) as n, unnest(gs) as k from g
), c as (
  select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as k from s a join s b on a.k = b.k and a.doc_id <> b.doc_id group by all
), l as (
  select a, b from c where 100 * k >= {ngram_join.PERCENT} * (na + nb - k)
), r(doc_id, c) as (
  select doc_id, doc_id from documents union select r.doc_id, l.b from r join l on l.a = r.c
)
select g.doc_id, len(gs)::bigint as n_shingles, m as component_id
from g join (select doc_id, min(c) as m from r group by doc_id) x on x.doc_id = g.doc_id
"""


#: Texts as hexadecimal digits, in blocks of 1,000 bytes that run on by a window. Windows that meet or overlap are one span.
_OP4 = f"""
with h as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as x from documents),
blocks as (select r, j, substr(x, 2000 * j + 1, 2000 + 2 * ({suffix_dedup.LENGTH} - 1)) as x from h, lateral (select unnest(range(0, strlen(x) // 2000 + 1)) as j) b),
starts as (select r, 1000 * j + i as p, md5_number(substr(x, 2 * i + 1, 2 * {suffix_dedup.LENGTH})) as k from blocks,
  lateral (select unnest(range(0, greatest(0, least(1000, strlen(x) // 2 - {suffix_dedup.LENGTH} + 1)))) as i) w),
twice as (select r, p from starts qualify count(*) over (partition by k) > 1),
fresh as (select r, p, coalesce(p - lag(p) over (partition by r order by p) > {suffix_dedup.LENGTH}, true)::int as f from twice),
runs as (select r, p, sum(f) over (partition by r order by p) as run from fresh),
spans as (select r, min(p) as a, max(p) + {suffix_dedup.LENGTH} as b from runs group by r, run),
ends as (select r, a, b from spans union all select r, strlen(x) // 2, null from h),
gaps as (select r, coalesce(lag(b) over (partition by r order by a, b nulls last), 0) as a, a as b from ends),
kept as (select h.r, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' order by a) as x from gaps join h on h.r = gaps.r group by h.r),
removed as (select r, sum(b - a)::bigint as n, count(*) as spans from spans group by r)
select doc_id, (strlen(h.x) // 2)::bigint as n_bytes, coalesce(n, 0) as n_removed, coalesce(spans, 0) as n_spans, sha256(unhex(kept.x)) as kept_sha256
from h join kept on kept.r = h.r left join removed on removed.r = h.r
"""


#: Paths are the digests of all turns up to one. crc counts a decimal's bytes bit by bit.
_OP11 = """
with crc as (select conv_id, list_reduce(list_transform(list_concat([4294967295::bigint], list_transform(range(1, length(conv_id::varchar) + 1), lambda i: ascii(substr(conv_id::varchar, i, 1))::bigint)), lambda x: x),
  lambda s, b: list_reduce(list_concat([xor(s, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)) as s from (select distinct conv_id from conversations where conv_id is not null)),
cs as (select conv_id, xor(s, 4294967295) % 6 as h, conv_id - conv_id % 100 as base from crc),
m as (select conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as k, length(coalesce(text, '')) as chars,
  row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 as pos from conversations where conv_id is not null),
r as (select cs.conv_id, 0 as part, pos, k, chars from cs join m on m.conv_id = cs.base where pos < h
  union all select cs.conv_id, 1, pos, k, chars from cs join m on m.conv_id = cs.conv_id where pos >= h),
p as (select conv_id, row_number() over w as depth, string_agg(k, '') over w as path, chars from r window w as (partition by conv_id order by part, pos rows unbounded preceding)
  union all select conv_id, 0, '', 0 from cs),
n as (select path, depth, chars, min(conv_id) as conv_id, count(*) as n_convs from p group by all),
f as (select conv_id, max(depth) as d from p group by conv_id),
e as (select path, string_agg(conv_id::varchar, ',' order by conv_id) as ids from p join f using (conv_id) where depth = d group by path),
kids as (select substr(path, 1, 64 * (depth - 1)) as path, count(*) as n from n where depth > 0 group by 1),
x as (select n.*, coalesce(kids.n, 0) as n_children from n left join kids using (path)),
a as (select substr(path, 1, 64 * d) as path, sum((n_convs - 1) * chars) as saved, count(*) filter (n_children = 0) as leaves from x, lateral (select unnest(range(0, depth + 1)) as d) group by 1)
select x.conv_id, x.depth::bigint as depth, u.conv_id as parent_conv_id, x.n_convs, x.n_children, leaves as n_leaves, saved::bigint as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from x join a using (path) left join e using (path) left join n u on x.depth > 0 and u.path = substr(x.path, 1, 64 * (x.depth - 1))
"""

_OP12 = """
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as ts from documents),
q as (select row_number() over () as i, item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))) as t from benchmark),
k as (select count(*)::bigint as nd, sum(len(ts))::bigint as l from d where len(ts) > 0),
p as (select r, doc_id, len(ts)::bigint as n, unnest(ts) as t from d),
c as (select r, doc_id, n, t, count(*)::bigint as tf from p where t in (select t from q) group by all),
w as (select t, floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1)))::bigint as w from c, k group by t, nd),
s as (select i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nd) // l))))::bigint as score from q join c using (t) join w using (t), k group by all),
z as (select *, row_number() over (partition by i order by score desc, doc_id nulls first) as rank from s where score > 0)
select item_id, rank::int as rank, doc_id, score from z where rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    table = ",".join(map(str, sharding.slot_table(SHARDS)))
    op8 = f"""
with t as (select string_split('{table}', ',') as claim),
d as (select doc_id, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint % {sharding.TABLE_SIZE} as shard_slot from documents)
select doc_id, shard_slot, claim[shard_slot + 1]::int as shard from d, t
"""
    return {"op1_embedding_near_dedup": _OP1, "op3_perspective_rotation": _OP3, "op4_suffix_array_dedup": _OP4, "op8_lookup_table_sharding": op8, "op10_signature_tree_join": _OP10, "op11_prefix_trie": _OP11, "op12_maxscore_search": _OP12}
