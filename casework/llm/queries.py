"""The queries opN_<name>: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casework.llm import (bwt_repeats, decontaminate, hard_negatives, langid, mixing, ngram_lm, pii, prefix_trie,
                          quality, recompress, sharding, simhash, topk)
from casework.sources.tables import table

SHARDS = 24
MIX_WEIGHTS = {
    "domain": {"web": 5, "reference": 3, "forum": 2},
    "lang": {"en": 50, "de": 20, "fr": 20, "es": 10},
    "source": {"src0": 3},
    "default": {"domain": 1, "lang": 5, "source": 1},
}
MIX_BUDGET = (3, 4)
MIX_EPOCHS = 2


def op1_word_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the 13-word windows that a smaller doc_id has too."""
    found = recompress.repeated_windows(table(spark, sf_dir, "documents"))
    return found.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def op2_byte_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings that a smaller doc_id has too."""
    found = bwt_repeats.repeated_strings(table(spark, sf_dir, "documents"))
    return found.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document."""
    found = decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "item_id", "first_word", "cosine", "overlap", "answer")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every 20th vector id against all vectors."""
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    ranker = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, ranker).select(
        "doc_id", quality.held_out("doc_id").alias("held_out"), "score",
        F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain and disguised personal data of every document."""
    return pii.find(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-balanced contiguous shards of all documents."""
    pos = sharding.shard_positions(table(spark, sf_dir, "documents"), SHARDS)
    return pos.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"),
                      F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken for three quarters of the tokens, at most two epochs."""
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, MIX_WEIGHTS, MIX_BUDGET, MIX_EPOCHS, domain_col="domain").select(
        "doc_id", "domain", "lang", "source", "epoch")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and bigram scores of all documents."""
    found = ngram_lm.score(table(spark, sf_dir, "documents"))
    return found.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "held_out", "n_tokens", "n_known",
                        "train_tokens", "base_score", "score")


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs)).withColumnsRenamed({"id": "doc_id", "lang": "lang_pred"})


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct sequence of first turns of the rebuilt conversations."""
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th vector; the label of every 7th is the next one."""
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", turned))


QUERIES = {
    "op1_word_repeats": op1_word_repeats,
    "op2_byte_repeats": op2_byte_repeats,
    "op3_decontaminate": op3_decontaminate,
    "op4_topk": op4_topk,
    "op5_quality": op5_quality,
    "op6_simhash": op6_simhash,
    "op7_pii": op7_pii,
    "op8_shard": op8_shard,
    "op9_mix_sources": op9_mix_sources,
    "op10_lm_score": op10_lm_score,
    "op11_language": op11_language,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_hard_negatives": op13_hard_negatives,
}


def _weight_sql(level: str, col: str) -> str:
    cases = " ".join(f"when '{k}' then {v}" for k, v in MIX_WEIGHTS.get(level, {}).items())
    return f"case {col} {cases} else {MIX_WEIGHTS['default'][level]} end"


def _share_sql(name: str, source: str, parent: str, key: str) -> str:
    """The budget of each child: full ones first, the rest by weight."""
    part = f"partition by {parent}" if parent else ""
    return f"""
{name}_a as (
  select *, have - coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0) as lft,
         sum(w) over (o rows between current row and unbounded following) as ws, row_number() over o as i
  from {source} where w > 0 and cap > 0 window o as ({part} order by cap / w, {key})),
{name}_b as (select *, min(case when not (cap * ws <= lft * w) then i end) over ({part}) as fi from {name}_a),
{name}_c as (select *, min(case when i = fi then lft end) over ({part}) as fl,
                    min(case when i = fi then ws end) over ({part}) as fw from {name}_b),
{name} as (select *, (case when fi is null or i < fi then cap else (fl * w) // fw end)::bigint as give from {name}_c)"""


OP9_SQL = f"""
with tagged as (
  select doc_id, lang, source, coalesce(lang, '(none)') as l, coalesce(source, '(none)') as s,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as n,
         try_cast(nullif(regexp_extract(coalesce(source, '(none)'), '([0-9]+)$', 1), '') as int) as num
  from documents),
docs as (
  select *, case when num is null then 'other' when num < 7 then 'web' when num < 14 then 'reference' else 'forum' end as d
  from tagged),
leaf as (select d, l, s, sum(n)::bigint as tokens, (sum(n) * {MIX_EPOCHS})::bigint as cap from docs group by all),
total as (select ((sum(tokens) * {MIX_BUDGET[0]}) // {MIX_BUDGET[1]})::bigint as t from leaf),
top_in as (select d, sum(cap)::bigint as cap, {_weight_sql('domain', 'd')} as w, (select t from total) as have from leaf group by d),
{_share_sql('tops', 'top_in', '', 'd')},
mid_in as (select leaf.d, leaf.l, sum(leaf.cap)::bigint as cap, {_weight_sql('lang', 'leaf.l')} as w, any_value(tops.give) as have
           from leaf join tops on leaf.d = tops.d group by leaf.d, leaf.l),
{_share_sql('mids', 'mid_in', 'd', 'l')},
low_in as (select leaf.*, {_weight_sql('source', 'leaf.s')} as w, mids.give as have
           from leaf join mids on leaf.d = mids.d and leaf.l = mids.l),
{_share_sql('lows', 'low_in', 'd, l', 's')},
quota as (select d, l, s, give // tokens as full_n, give % tokens as rest from lows where give > 0),
keyed as (select docs.*, full_n, rest, md5(concat('0:', full_n, ':', coalesce(doc_id::varchar, ''))) as k
          from docs join quota using (d, l, s)),
summed as (select *, sum(n) over (partition by d, l, s order by k, coalesce(doc_id::varchar, '')) as upto from keyed),
taken as (select *, full_n + case when rest > 0 and upto <= rest then 1 else 0 end as times from summed)
select doc_id, d as domain, lang, source, unnest(range(times))::int as epoch from taken where times > 0
"""

OP1_SQL = """
with docs as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
windows as (
  select doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') as k
  from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from docs)),
least as (select k, min(doc_id) as m from windows group by k),
gone as (
  select distinct doc_id, unnest(range(i, i + 13)) as p from windows join least using (k) where m < doc_id),
places as (select doc_id, unnest(range(1, len(ws) + 1)) as p, unnest(ws) as w from docs),
kept as (
  select places.doc_id, string_agg(w, ' ' order by places.p) as t, count(*) as n
  from places left join gone on places.doc_id = gone.doc_id and places.p = gone.p where gone.p is null group by places.doc_id)
select docs.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed,
       sha256(coalesce(t, '')) as kept_sha256
from docs left join kept using (doc_id)
"""

OP4_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select q.vec_id as query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2]))::bigint as score
  from v as q join v on q.vec_id != v.vec_id where q.vec_id % 20 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from pairs)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""

OP13_SQL = """
with v as (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.r, a.vec_id as anchor_id, v.vec_id, a.label = v.label as same,
         list_sum(list_transform(list_zip(a.e, v.e), lambda p: p[1] * p[2]))::bigint as score
  from v as a join v on a.r != v.r and len(a.e) = len(v.e) where a.vec_id % 50 = 0),
best as (
  select *, row_number() over (partition by r order by score desc, vec_id) as slot from scored where same qualify slot <= 5),
ranked as (
  select best.anchor_id, best.vec_id as positive_id, scored.vec_id as negative_id, best.score as positive_score,
         scored.score as negative_score,
         row_number() over (partition by best.r, slot order by scored.score desc, scored.vec_id)::int as rank
  from best join scored on best.r = scored.r and not scored.same
   and 50 * best.score <= 100 * scored.score and 100 * scored.score <= 95 * best.score)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ranked where rank <= 3
"""

OP12_SQL = """
with recursive steps(i, c, k) as (
  select i::bigint, i::bigint, 0 from range(256) as t(i)
  union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from steps where k < 8),
crc as (select list(c order by i) as t from steps where k = 8),
turns as (
  select conv_id, md5(concat(len(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) as id,
         len(coalesce(text, '')) as chars, turn from conversations where conv_id is not null),
own as (
  select conv_id, list(id order by turn nulls first, id) as ids, list(chars order by turn nulls first, id) as chars
  from turns group by conv_id),
cut as (
  select own.*, xor(4294967295, list_reduce(list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::bigint)) % 6 as h from own, crc),
rebuilt as (
  select cut.conv_id, coalesce(base.ids[:h], []) || cut.ids[h + 1:] as ids,
         coalesce(base.chars[:h], []) || cut.chars[h + 1:] as chars
  from cut left join own as base on base.conv_id = cut.conv_id - cut.conv_id % 100),
spread as (select *, unnest(range(0, len(ids) + 1)) as depth from rebuilt),
placed as (
  select conv_id, depth, len(ids) = depth as last, md5(array_to_string(ids[:depth], ',')) as node,
         case when depth > 0 then md5(array_to_string(ids[:depth - 1], ',')) end as parent,
         case when depth > 0 then chars[depth] else 0 end as chars from spread),
nodes as (
  select node, depth, any_value(parent) as parent, any_value(chars) as chars, min(conv_id) as conv_id, count(*) as n_convs,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where last), '')) as ends_sha256
  from placed group by node, depth),
kids as (select parent as node, depth - 1 as depth, count(*) as n from nodes where parent is not null group by all),
full_nodes as (select nodes.*, coalesce(kids.n, 0) as n_children from nodes left join kids on nodes.node = kids.node and nodes.depth = kids.depth),
below as (
  select up.node, up.depth, sum((f.n_children = 0)::int) as n_leaves, sum((f.n_convs - 1) * f.chars) as saved_tokens
  from full_nodes as f join placed as up on f.conv_id = up.conv_id and up.depth <= f.depth group by up.node, up.depth)
select f.conv_id, f.depth::bigint as depth, p.conv_id as parent_conv_id, f.n_convs, f.n_children, n_leaves::bigint as n_leaves,
       saved_tokens::bigint as saved_tokens, f.ends_sha256
from full_nodes as f join below on f.node = below.node and f.depth = below.depth
left join nodes as p on f.parent = p.node and p.depth = f.depth - 1
"""

ORACLE = {
    "op1_word_repeats": OP1_SQL,
    "op4_topk": OP4_SQL,
    "op9_mix_sources": OP9_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
