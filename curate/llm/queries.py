"""One registered query per operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import query, table
from curate.llm import alignment, bpe, html_text, language, line_rules, near_dups, packing, quality, secret_scan, token_files, top_k, turn_trie, vector_dups
from curate.llm.common import crc32_of_id
from curate.session import scratch_path

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


@query()
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    score = F.col("quality_score")
    return quality.score_quality(docs.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(F.pmod(crc32_of_id("doc_id"), F.lit(4)) == 2, F.lit(False)).alias("held_out"),
        score.alias("score"),
        (score >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


# All pairs by cosine, and everything that links lead to.
LINKED_VECTORS = """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
n as (select vec_id, e, sqrt(list_dot_product(e, e)) as n from v),
l as (select a.vec_id as a, b.vec_id as b from n a join n b on a.vec_id <> b.vec_id and list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
r as (select vec_id as a, vec_id as b from embeddings union select r.a, l.b from r join l on r.b = l.a)
select e.vec_id, (select count(*) from l where l.a = e.vec_id) as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join (select a, min(b) as component_id from r group by a) c on c.a = e.vec_id
"""


@query(LINKED_VECTORS)
def op2_vector_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dups.near_vectors(table(spark, sf_dir, "embeddings"), 0.95)


@query()
def op3_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE, end_id=2, capacity=4096)


@query()
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train_language(docs)
    return language.identify_language(docs.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(F.pmod(crc32_of_id("doc_id"), F.lit(5)) == 0, F.lit(False)).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
    )


@query()
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.digest(docs, secret_scan.learn_formats(docs))


# Integer components and products, all pairs of a query and a row, and the five best by score and id.
TOP_K = """
with v as (select distinct vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
           from embeddings
           where vec_id is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
     s as (select q.vec_id as query_id, c.vec_id,
                  cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
           from v q, v c
           where q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
     r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""


@query(TOP_K)
def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_inner_products(table(spark, sf_dir, "embeddings"), k=5, every=50, scale=256)


@query()
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, WORD_BPE, end_id=1)
    return token_files.read_token_files(spark, folder)


@query()
def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


# Sets of shingles as texts, pairs that share one, their Jaccard similarity, and everything that links lead to.
LINKED_DOCUMENTS = r"""
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
s as (
  select doc_id, case when len(words) >= 5 then list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')))
    when len(words) > 0 then [array_to_string(words, ' ')] else [] end as shingles from w),
u as (select doc_id, len(shingles) as n, unnest(shingles) as shingle from s),
p as (select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as shared from u a join u b on a.shingle = b.shingle and a.doc_id <> b.doc_id
      group by a.doc_id, b.doc_id, a.n, b.n),
l as (select a, b from p where 100 * shared >= 85 * (na + nb - shared)),
r as (select doc_id as a, doc_id as b from documents union select r.a, l.b from r join l on r.b = l.a)
select s.doc_id, cast(len(s.shingles) as bigint) as n_shingles, c.component_id, s.doc_id = c.component_id as kept
from s join (select a, min(b) as component_id from r group by a) c on c.a = s.doc_id
"""


@query(LINKED_DOCUMENTS)
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query()
def op10_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_documents(table(spark, sf_dir, "documents"), BYTE_BPE)
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


# Counts of words, signs, lines and repeated windows by lists; the verdict of the line rules by regular expressions.
LINE_RULES = r"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (
  select r, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
g as (select r, i, words[i:i + 2] as three from (select r, words, unnest(range(1, len(words) - 1)) as i from w)),
t as (select r, i from g qualify count(*) over (partition by r, three) > 1),
n as (select r, count(distinct i + k) as n_repeat_words from t, (select unnest([0, 1, 2]) as k) group by r),
l as (
  select r, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
    translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from (select r, unnest(lines) as line from w)),
m as (
  select r, line, low, len(words) as n, len(list_filter(words, lambda x: x in ('|', '»', '«', '›', '‹', '>', '·', '•', '→', '/', '::'))) as seps,
    len(regexp_extract_all(line, '[!-/:-@\[-`{-~]')) as marks, len(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) as chars,
    regexp_matches(line, '[.!?…:;。！？]["''”’»)\]}]*[\x20\x09-\x0D]*$') as closed,
    len(list_filter(words, lambda x: regexp_matches(x, '[.!?…]$'))) as ends from l),
j as (
  select r, sum(n) as lost from m
  where (seps >= 2 and seps * 5 >= n)
    or (n <= 40 and regexp_matches(low, 'all rights reserved|terms of use|terms of service|privacy policy|cookie policy|use cookies|licensed under|enable javascript|sign up for|subscribe to our|follow us on|lorem ipsum|powered by|skip to content'))
    or (marks >= 10 and 100 * marks > 15 * chars) or not (closed or (n >= 10 and ends * 50 >= n))
  group by r),
b as (
  select r, doc_id, len(words)::bigint as n_words, len(array_to_string(words, ''))::bigint as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(lost, 0) as lost
  from w left join n using (r) left join j using (r)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and 100 * lost <= 50 * n_words as kept from f
"""


@query(LINE_RULES)
def op11_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query()
def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align_corpus(table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE, groups=False)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


# Whole paths as lists, their prefixes as nodes, and every node's ancestors along the path of its smallest member. CRC-32 is
# worked out bit by bit.
TURN_TRIE = """
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
  from conversations where conv_id is not null),
o as (select conv_id, list([role, text] order by pos) as turns from t group by conv_id),
c as (
  select conv_id, turns, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
    lambda s, x: list_reduce(list_prepend(xor(s, x), range(8)), lambda d, i: case when d % 2 = 1 then xor(d // 2, 3988292384) else d // 2 end))) % 6 as h
  from o),
r as (
  select c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) as path
  from c left join o b on b.conv_id = c.conv_id - c.conv_id % 100),
p as (
  select conv_id, depth, len(path) = depth as ends, md5(to_json(path[1:depth])::varchar) as node, md5(to_json(path[1:depth - 1])::varchar) as parent,
    case when depth > 0 then length(path[depth][2]) else 0 end as chars
  from (select conv_id, path, unnest(range(0, len(path) + 1)) as depth from r)),
n as (
  select node, depth, any_value(parent) as parent, min(conv_id) as conv_id, count(*) as n_convs, any_value(chars) as chars,
    sha256(coalesce(string_agg(case when ends then conv_id::varchar end, ',' order by conv_id), '')) as ends_sha256
  from p group by node, depth),
k as (select parent as node, count(*) as n_children from n where depth > 0 group by parent),
s as (
  select p.node, count(*) filter (k.node is null) as n_leaves, sum((n.n_convs - 1) * n.chars) as saved_tokens
  from n join p on p.conv_id = n.conv_id and p.depth <= n.depth left join k on k.node = n.node group by p.node)
select n.conv_id, n.depth, u.conv_id as parent_conv_id, n.n_convs, coalesce(k.n_children, 0) as n_children, s.n_leaves,
  s.saved_tokens::bigint as saved_tokens, n.ends_sha256
from n join s using (node) left join k using (node) left join n u on n.depth > 0 and u.node = n.parent
"""


@query(TURN_TRIE)
def op13_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_trie.prefix_trie(table(spark, sf_dir, "conversations"))
