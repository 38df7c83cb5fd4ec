"""The registered queries of this subpackage, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelworks.llm import alignment, conversation_trie, exact, jaccard, line_templates, packing, pieces, preference, quality, records, secrets, sharding, token_counts
from panelworks.llm.common import table

SHARDS = [f"shard-{k:03d}" for k in range(48)]


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def words() -> list[str]:
    return secrets.frequent_words(byte_bpe())


def op1_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with its neighbour's last reply: prompt once, masked completions."""
    out = preference.format_turns(preference.last_reply_turns(table(spark, sf_dir, "conversations")))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return out.withColumn("spans", spans)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), byte_bpe())


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).drop("text_key", "class_key")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(table(spark, sf_dir, "documents"), piece_model())


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.drop_recurring_lines(docs)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings and the digest of the masked text of every document."""
    out = secrets.scan_with_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), words())
    return out.select("doc_id", "n_candidates", "n_secrets", F.array_join("secrets", " ").alias("secrets"), F.sha2("text", 256).alias("masked_sha256"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup_exact(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op9_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = records.write_records(table(spark, sf_dir, "documents"), byte_bpe())
    return records.read_records(index)


def op10_shard_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document goes: its slot, shard and the bytes that it brings."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return sharding.place(docs, "doc_id", SHARDS)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(table(spark, sf_dir, "conversations")).drop("name", "parent_name")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), word_bpe())


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"), byte_bpe(), piece_model())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_preference_format": op1_preference_format,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_line_templates": op5_line_templates,
    "op6_secret_scan": op6_secret_scan,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_quality_rules": op8_quality_rules,
    "op9_binary_records": op9_binary_records,
    "op10_shard_table": op10_shard_table,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_token_counts": op12_token_counts,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}


def sql() -> dict[str, str]:
    filled = ",".join(map(str, sharding.lookup_table(SHARDS)))
    return {
        "op1_preference_format": OP1_SQL,
        "op7_exact_dedup": OP7_SQL,
        "op11_conversation_trie": OP11_SQL,
        "op10_shard_table": f"""
            with filled as (select string_split('{filled}', ',') as owner)
            , placed as (
              select doc_id, source, coalesce(strlen(text), 0)::bigint as n_bytes
              , (('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint % {sharding.SLOTS})::bigint as slot
              from documents)
            select slot, doc_id, source, n_bytes, 'shard-' || lpad(owner[slot + 1], 3, '0') as shard
            from placed, filled""",
    }


OP1_SQL = """
with turns as (
  select distinct conv_id, coalesce(turn, -9223372036854775808)::bigint as turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null)
, last as (select conv_id, max(turn) as last from conversations where role = 'assistant' and turn is not null group by 1)
, reply as (
  select xor(t.conv_id, 1) as pair_id, role, text from turns t join last l using (conv_id) where turn = last and role = 'assistant')
, rejected as (
  select distinct t.conv_id as pair_id, turn, role, text from turns t join last l using (conv_id)
  where turn < last and conv_id in (select pair_id from reply)
  union
  select pair_id, l.last as turn, role, text from reply r join last l on l.conv_id = r.pair_id)
, c as (select conv_id as pair_id, turn, list(role || chr(0) || text order by role, text) as m from turns group by all)
, r as (select pair_id, turn, list(role || chr(0) || text order by role, text) as m from rejected group by all)
, both_sides as (
  select coalesce(c.pair_id, r.pair_id) as pair_id, coalesce(c.turn, r.turn) as turn, c.m is distinct from r.m as differs, c.m is not null as has_c, r.m is not null as has_r
  from c full join r on c.pair_id = r.pair_id and c.turn = r.turn)
, sides as (
  select pair_id, min(turn) filter (where differs) as differ, bool_or(has_c) and bool_or(has_r) as paired from both_sides group by 1)
, prefix as (
  select pair_id, count(*) filter (where turn < coalesce(differ, 1e18)) as prefix_turns from both_sides join sides using (pair_id) group by 1)
, parts as (
  select conv_id as pair_id, case when turn < coalesce(differ, 1e18) then 'prompt' else 'chosen' end as part, turn, role, text
  from turns t join sides s on s.pair_id = t.conv_id
  union all
  select pair_id, 'rejected', turn, role, text from rejected join sides using (pair_id) where turn >= coalesce(differ, 1e18))
, rendered as (
  select *, '<|' || role || '|>' || chr(10) as head, text || '<|end|>' || chr(10) as body, floor(turn / 256)::bigint as block from parts)
, placed as (
  select *, sum(length(head) + length(body)) over (partition by pair_id, part order by turn, role, text)
    - length(body) as s from rendered)
select pair_id, part, block, min(s - length(head))::bigint as start
, string_agg(head || body, '' order by turn, role, text) as text
, coalesce(string_agg(s::bigint || '-' || (s + length(body))::bigint, ',' order by turn, role, text) filter (where role = 'assistant' and part <> 'prompt'), '') as spans
, count(*) as n_messages
, coalesce(sum(length(body)) filter (where role = 'assistant' and part <> 'prompt'), 0)::bigint as trained_chars
, any_value(prefix_turns) as prefix_turns
, any_value(paired) as paired
from placed join prefix using (pair_id) join sides using (pair_id)
group by pair_id, part, block
"""

#: The two lowest bits of CRC-32 decide how many turns come from the family's first conversation; it is worked out bit by bit.
OP11_SQL = r"""
with ids as (select distinct conv_id from conversations where conv_id is not null)
, crc as (select conv_id, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda c: ord(c)::bigint))
    , lambda a, b: list_reduce(list_prepend(xor(a, b), [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)), 4294967295) as crc from ids)
, heads as (select conv_id, conv_id - conv_id % 20 as base, crc % 4 as h from crc)
, turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as pos
  , md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as symbol, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words from conversations where conv_id is not null)
, rebuilt as (
  select i.conv_id, 0 as part, pos, symbol, words from heads i join turns t on t.conv_id = i.base where pos < h
  union all select i.conv_id, 1, pos, symbol, words from heads i join turns t on t.conv_id = i.conv_id where pos >= h)
, seqs as (select *, row_number() over (partition by conv_id order by part, pos) as depth from rebuilt)
, named as (select conv_id, depth, words, md5(string_agg(symbol, '') over (partition by conv_id order by depth)) as name from seqs)
, paths as (
  select conv_id, depth, words, name, coalesce(lag(name) over (partition by conv_id order by depth), 'root') as parent from named
  union all select conv_id, 0, 0, 'root', null from ids)
, nodes as (select name, any_value(parent) as parent, any_value(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(words) as words from paths group by 1)
, kids as (select parent as name, count(*) as n_children from nodes group by 1)
, told as (select n.*, coalesce(n_children, 0) as n_children, (n_convs - 1) * words as saved from nodes n left join kids using (name))
, totals as (
  select p.name, sum((n_children = 0)::int)::bigint as n_leaves, sum(saved)::bigint as saved_tokens from told n join paths p on p.conv_id = n.conv_id and p.depth <= n.depth group by 1)
, ends as (
  select name, sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends from (select conv_id, max_by(name, depth) as name from paths group by 1) group by 1)
select t.conv_id, t.depth::bigint as depth, o.conv_id as parent_conv_id, t.n_convs, t.n_children, n_leaves, saved_tokens, coalesce(ends, sha256('')) as ends_sha256
from told t join totals using (name) left join ends using (name) left join nodes o on o.name = t.parent
"""

OP7_SQL = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over same as keep_id, count(*) over same as group_size, row_number() over (same order by doc_id) = 1 as kept, sha256(t) as text_sha256
from t window same as (partition by t)
"""

SQL = sql()
