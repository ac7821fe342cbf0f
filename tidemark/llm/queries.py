"""The numbered queries of this subpackage over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.chat_format import chat_digests, format_chats
from tidemark.llm.common import documents
from tidemark.llm.importance import importance_resample
from tidemark.llm.license_scan import scan_licenses
from tidemark.llm.line_dedup import kept_text, line_dedup
from tidemark.llm.media import media_columns
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.mix import mix_sources
from tidemark.llm.prefix_forest import nearest
from tidemark.llm.quality_rules import quality_rules
from tidemark.llm.sentencepiece_codec import round_trips
from tidemark.llm.suffix_dedup import repeated_passages
from tidemark.llm.token_orc import tokens_of
from tidemark.llm.turn_repair import damage, repair_conversations, repair_digests


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "class_size", "kept")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op4_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_of(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(kept_text().cast("binary"), 256).alias("kept_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.sql(f"select -1L as conv_id, cast(turn as bigint) as turn, role, '{said}' as text from values (0, 'user'), (1, 'assistant') as t(turn, role)")
    return chat_digests(format_chats(rows.unionByName(probe)))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(documents(spark, sf_dir))


def op11_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % 20 == 0)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return repair_digests(repair_conversations(damage(rows), lost_col="lost"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_license_scan, op2_minhash, op3_mix, op4_token_orc, op5_line_dedup, op6_quality_rules, op7_chat_format, op8_suffix_dedup, op9_sentencepiece, op10_media, op11_prefix_forest, op12_importance, op13_turn_repair)}

ORACLE_SQL: dict[str, str] = {
    "op5_line_dedup": r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
keyed as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines),
hot as (select key from keyed where length(key) >= 1 group by key having count(distinct doc_id) >= 10),
marked as (select k.*, h.key is not null as dropped from keyed k left join hot h on k.key = h.key)
select doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) as kept_sha256
from marked group by doc_id""",
    "op7_chat_format": r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped as (
  select *, replace(replace(replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<|', '&lt;|'), '<s>', '&lt;s>'),
    '</s>', '&lt;/s>'), '<<SYS>>', '&lt;<SYS>>'), '<</SYS>>', '&lt;</SYS>>'), '[INST]', '&#91;INST]'), '[/INST]', '&#91;/INST]') as safe,
    lag(role) over (partition by conv_id order by turn, role, text) is not distinct from role as merged
  from rows)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(safe) + case when merged then 8 else 8 + length(role) + 8 + 7 end)::bigint as formatted_chars
from escaped group by conv_id""",
    "op11_prefix_forest": r"""
with valid as (
  select distinct vec_id, embedding::double[] as e from embeddings
  where vec_id is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform(embedding, lambda x: x <> 0))),
met as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e) as score
  from valid q join valid c on len(q.e) = len(c.e) and q.vec_id <> c.vec_id where q.vec_id % 20 = 0)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from met qualify rank <= 20""",
    "op12_importance": r"""
with crc as materialized (
  select list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
    lambda c, step: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
texts as (
  select 's' as side, row_number() over () as id, doc_id, coalesce(text, '') as text from documents
  union all select 't', row_number() over (), null, coalesce(text, '') from benchmark),
cut as materialized (
  select side, id, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\x{80}-\x{10FFFF}]+') as w from texts),
grams as materialized (
  select side, id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])
    || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as gram from cut),
hashed as materialized (
  select gram, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: (position(x[i] in '0123456789ABCDEF') - 1) * 16 + position(x[i + 1] in '0123456789ABCDEF') - 1)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket
  from (select gram, hex(encode(gram)) as x from (select distinct gram from grams)), crc),
found as materialized (select side, id, bucket, count(*) as n from grams join hashed using (gram) group by all),
sums as (select bucket, coalesce(sum(n) filter (side = 's'), 0) as s, coalesce(sum(n) filter (side = 't'), 0) as t from found group by bucket),
gains as (
  select bucket, floor(1000 * ln((t + 1)::double * (all_s + 10000) / ((s + 1)::double * (all_t + 10000))))::bigint as gain
  from sums, (select sum(s) as all_s, sum(t) as all_t from sums)),
weights as (select id, sum(n * gain)::bigint as weight from found join gains using (bucket) where side = 's' group by id),
scored as (
  select doc_id, len(w) as n, len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || coalesce(doc_id::varchar, '')), 8))::bigint + 0.5::double) / 4294967296.0::double)))::bigint as score
  from cut left join weights using (id) where side = 's'),
placed as (
  select *, row_number() over (partition by n >= 20 order by score desc, doc_id nulls last) as place, 5 * count(*) filter (n >= 20) over () // 100 as most from scored)
select doc_id, n_features::bigint as n_features, weight, score, case when n >= 20 and place <= most then place end as rank from placed""",
    "op13_turn_repair": r"""
with recursive
crc as (
  select list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
    lambda c, step: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
drawn as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ord(x)::bigint)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as draw
  from conversations, crc),
damaged as (
  select conv_id, turn, case when draw = 4 then 'user' else role end as role,
    case draw when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
    unnest(case when draw = 3 then [0, 1] else [0] end) as copy
  from drawn where draw <> 0),
judged as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
    trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as seen
  from damaged),
turns as (
  select *, case when bare = '' then 'blank' when seen then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
    left(role, 1) as first, lag(left(role, 1)) over (partition by conv_id order by i) as before
  from judged),
steps(p, c, q) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserted(p, q, cost, audit, said) as (values (0, 0, 0, '', []::varchar[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 3, 'I', ['user:']), (0, 3, 6, 'II', ['user:', 'assistant:']),
  (1, 2, 3, 'I', ['user:']), (1, 3, 6, 'II', ['user:', 'assistant:']), (2, 3, 3, 'I', ['assistant:']), (3, 2, 3, 'I', ['user:'])),
edits as (
  select conv_id, i, s.p, s.p as q, 4 as cost, 'D' as audit, []::varchar[] as said from turns, (values (0), (1), (2), (3)) as s(p)
  union all
  select conv_id, i, p, q, 3 * (fault = 'truncated')::int, 'K', [role || ':' || text] from turns join steps on first = c where fault not in ('blank', 'duplicate')
  union all
  select conv_id, i, p, q, 3 + 3 * (fault = 'truncated')::int, 'R', [case c when 'u' then 'user:' else 'assistant:' end || text] from turns, steps where c <> 's' and fault not in ('blank', 'duplicate')),
moves as (
  select conv_id, e.i, e.p, n.q, e.cost + n.cost as cost, e.audit || n.audit as audit, list_concat(e.said, n.said) as said
  from edits e join inserted n on e.q = n.p),
best(conv_id, i, p, cost, audit, said) as (
  select c.conv_id, 0::bigint, n.q, n.cost, n.audit, n.said from (select distinct conv_id from turns) c, inserted n where n.p = 0
  union all
  (select b.conv_id, m.i, m.q, b.cost + m.cost, b.audit || m.audit, list_concat(b.said, m.said)
   from best b join moves m on b.conv_id is not distinct from m.conv_id and m.i = b.i + 1 and m.p = b.p
   qualify row_number() over (partition by b.conv_id, m.q order by b.cost + m.cost, b.audit || m.audit) = 1)),
counted as (
  select conv_id, max(i) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
    count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (before || first not in ('su', 'ua', 'au')) as illegal
  from turns group by conv_id),
fixed as (
  select b.conv_id, b.cost, b.audit, b.said from best b join counted c on b.conv_id is not distinct from c.conv_id and b.i = c.n
  where b.p in (0, 3) qualify row_number() over (partition by b.conv_id order by b.cost, b.audit) = 1)
select a.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, coalesce(f.cost, 0)::bigint as cost, coalesce(f.audit, '') as audit, sha256(coalesce(array_to_string(f.said, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) a
left join counted c on a.conv_id is not distinct from c.conv_id left join fixed f on a.conv_id is not distinct from f.conv_id""",
}
