"""Chunks, embeddings, upsampling and token tables."""

from __future__ import annotations

import tempfile
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.encoder_file import DIM as ENCODER_DIM
from catalog.encoder_file import encoder_bytes
from catalog.fixtures import WS
from catalog.registry import query, table
from curate.functions.text import words
from curate.functions.vectors import first_chunk
from curate.models.encoder import ship
from curate.operators.embedding import HashedWords, chunk_rows, collect_chunks, embed
from curate.operators.rehydrate import rehydrate, upsampling_weight
from curate.operators.tokens import copies, encode, shard_by_tokens, tokenize
from curate.session import join_lookup, settle

WORDS_CTE = f"""
worded AS (
  SELECT *, list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '') AS words FROM documents)
"""
SIZE = 510
DIM = 64
# Vectors are single floats: decides ties of rounding, and is less than what lies between two sums over 510 words.
_UP = 6e-8


@query(f"""WITH {WORDS_CTE}, starts AS (
    SELECT doc_id, words, unnest(range(0, greatest(len(words), 1), {SIZE})) AS s FROM worded)
    SELECT doc_id, (s // {SIZE})::INT AS chunk_no, words[s + 1 : s + {SIZE}] AS tokens FROM starts""")
def overflow_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_rows(table(spark, sf_dir, "documents"), "doc_id", words(F.col("text")), SIZE)


_VECTORS_CTE = f"""{WORDS_CTE}, placed AS (
  SELECT doc_id, i // {SIZE} AS chunk_no, ('0x' || substr(h, 1, 6))::INT % {DIM} AS place,
    CASE WHEN substr(h, 7, 1) < '8' THEN 1 ELSE -1 END AS sign
  FROM (SELECT doc_id, md5(word) AS h, i FROM (
    SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM worded))),
cells AS (
  SELECT doc_id, chunk_no, place, sum(sign) AS total FROM placed GROUP BY ALL),
sizes AS (
  SELECT doc_id, c AS chunk_no, least({SIZE}, len(words) - c * {SIZE}) AS n
  FROM (SELECT doc_id, words, unnest(range(0, (greatest(len(words), 1) + {SIZE - 1}) // {SIZE})) AS c FROM worded)),
vectors AS (
  SELECT s.doc_id, s.chunk_no, list(round(coalesce(c.total, 0) / greatest(s.n, 1e-9)::DOUBLE + {_UP}, 4) ORDER BY d) AS vector
  FROM sizes s CROSS JOIN (SELECT unnest(range(0, {DIM})) AS d)
  LEFT JOIN cells c ON c.doc_id = s.doc_id AND c.chunk_no = s.chunk_no AND c.place = d GROUP BY ALL)
"""


def _rounded(embeddings):
    return F.transform(
        embeddings, lambda vector: F.transform(vector, lambda x: F.round(x.cast("double") + _UP, 4))
    )


@query(f"""WITH {_VECTORS_CTE} SELECT doc_id, list(vector ORDER BY chunk_no) AS embeddings FROM vectors GROUP BY doc_id""")
def document_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunked, embedded and put together inside each row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    vectors = embed(words(F.col("text")), partial(HashedWords, DIM), SIZE)
    return docs.select("doc_id", vectors.alias("embeddings")).select(
        "doc_id", _rounded(F.col("embeddings")).alias("embeddings")
    )


# A begin and an end sign around every chunk, and all its token vectors averaged.
_ENCODED = f"""WITH {WORDS_CTE}, cut AS (
  SELECT doc_id, words, unnest(range(0, (greatest(len(words), 1) + {SIZE - 1}) // {SIZE})) AS chunk_no FROM worded),
ids AS (
  SELECT doc_id, chunk_no, unnest(list_concat([1, 2], list_transform(words[chunk_no * {SIZE} + 1 : (chunk_no + 1) * {SIZE}],
    lambda w: 3 + (length(w) * 31 + ascii(w)) % 61))) AS id FROM cut),
vectors AS (
  SELECT doc_id, chunk_no, list(v ORDER BY d) AS vector FROM (
    SELECT doc_id, chunk_no, d, round(avg(((id * 7 + d * 3) % 11 - 5) / 5.0::DOUBLE) + {_UP}, 4) AS v
    FROM ids, (SELECT unnest(range(0, {ENCODER_DIM})) AS d) GROUP BY ALL) GROUP BY ALL)
SELECT doc_id, list(vector ORDER BY chunk_no) AS embeddings FROM vectors GROUP BY doc_id"""


@query(_ENCODED)
def encoded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents in windows through a model file, batched by length."""
    folder = tempfile.mkdtemp(prefix="encoder-")
    path = f"{folder}/tiny-encoder.onnx"
    with open(path, "wb") as file:
        file.write(encoder_bytes())
    encoder = ship(spark, path, begin=[1], end=[2])
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = F.transform(words(F.col("text")), lambda w: (3 + (F.length(w) * 31 + F.ascii(w)) % 61).cast("long"))
    return docs.select("doc_id", _rounded(embed(ids, encoder, SIZE)).alias("embeddings"))


@query(f"""WITH {_VECTORS_CTE} SELECT doc_id, list(vector ORDER BY chunk_no) AS embeddings FROM vectors GROUP BY doc_id""")
def chunk_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks embedded one per row, then gathered per document."""
    rows = chunk_rows(table(spark, sf_dir, "documents"), "doc_id", words(F.col("text")), SIZE)
    vectors = embed(F.col("tokens"), partial(HashedWords, DIM), SIZE)
    embedded = rows.select("doc_id", "chunk_no", vectors.alias("_one")).select(
        "doc_id", "chunk_no", first_chunk(F.col("_one")).alias("vector")
    )
    return collect_chunks(embedded, "doc_id").select(
        "doc_id", _rounded(F.col("embeddings")).alias("embeddings")
    )


def _boundary_size():
    """Cluster sizes at and around every step of the weights."""
    sizes = F.array(*[F.lit(n) for n in (-1, 0, 1, 2, 3, 4, 5, 99, 100, 999, 1000, 5000)])
    return F.element_at(sizes, (F.col("doc_id") % 12 + 1).cast("int"))


_SIZE = "([-1, 0, 1, 2, 3, 4, 5, 99, 100, 999, 1000, 5000])[doc_id % 12 + 1]"
_WEIGHT = """CASE WHEN {s} < 1 THEN 1 WHEN {s} < 2 THEN 1 WHEN {s} < 3 THEN 2 WHEN {s} < 5 THEN 3
    WHEN {s} < 100 THEN 5 WHEN {s} < 1000 THEN 8 ELSE 1 END"""


@query(f"""SELECT doc_id, {_SIZE} AS cluster_size, {_WEIGHT.format(s=_SIZE)} AS weight FROM documents""")
def upsampling_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = _boundary_size()
    return table(spark, sf_dir, "documents").select(
        "doc_id", size.alias("cluster_size"), upsampling_weight(size).alias("weight")
    )


@query(f"""WITH c AS (
    SELECT doc_id, text, count(*) OVER (PARTITION BY md5(lower(trim(text)))) AS size FROM documents)
    SELECT doc_id, text, size, unnest(range(1, {_WEIGHT.format(s='size')} + 1))::INT AS copy_no FROM c""")
def rehydrated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents repeated by the size of their cluster of equal texts.

    Cluster sizes are counted on digests; only those of more than one copy are joined back, and a text that
    fills a third of the table is one row among them. All other documents have size one.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = F.md5(F.lower(F.trim("text"))).alias("digest")
    sizes = docs.select(digest).groupBy("digest").agg(F.count("*").alias("size")).where("size > 1")
    sized = join_lookup(docs.select("doc_id", "text", digest), sizes, ["digest"], "left").drop("digest")
    sized = sized.withColumn("size", F.coalesce("size", F.lit(1).cast("long")))
    return rehydrate(sized, F.col("size")).select("doc_id", "text", "size", "copy_no")


_TOKENS_CTE = f"""{WORDS_CTE}, tokenized AS (
  SELECT doc_id, list_transform(words, lambda w: ('0x' || substr(md5(w), 1, 7))::INT % 131072) AS tokens,
    {_WEIGHT.format(s=_SIZE)} AS weight FROM worded),
copies AS (
  SELECT doc_id, unnest(range(1, weight + 1))::INT AS copy_no, tokens, len(tokens)::INT AS n_tokens FROM tokenized)
"""


@query(f"WITH {_TOKENS_CTE} SELECT * FROM copies")
def tokenized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tokenize(docs, "doc_id", cluster_size=_boundary_size())


_SHARD = 20_000


@query(f"""WITH {_TOKENS_CTE} SELECT doc_id, copy_no, n_tokens,
    (coalesce(sum(n_tokens) OVER (ORDER BY doc_id, copy_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {_SHARD})::BIGINT AS shard
    FROM copies""")
def token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tokens = copies(settle(encode(docs, "doc_id", cluster_size=_boundary_size())), "doc_id")
    return shard_by_tokens(tokens, "doc_id", _SHARD).select("doc_id", "copy_no", "n_tokens", "shard")
