"""Whole chains of operators, and their behaviour on bags, duplicates and missing values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.encoding import _SHARD, _TOKENS_CTE, WORDS_CTE, _boundary_size
from catalog.fixtures import FOREST_CTE, LABELLED_CTE, labelled_documents, message_forest
from catalog.mixing import _MIXTURE_CTE, NUM_SAMPLES, mapping_table, source_tables
from catalog.registry import query, table
from catalog.sampling import SPLIT_CTE
from catalog.selecting import MLP_CTE, small_network
from catalog.texts import V1
from catalog.threads import _LEAVES
from curate.operators import sampling as S
from curate.operators.quantiles import corpus_threshold
from curate.operators.rehydrate import rehydrate
from curate.operators.tokens import read_shards, tokenize
from curate.plans.dataset import build_dataset, lines_from_jsonl, train_and_inspect, write_token_shards
from curate.plans.select import select_top
from curate.session import scratch_path, settle
from curate.sources.documents import nest_metadata, read_documents, read_labelled_embeddings
from curate.sources.sinks import write_documents, write_jsonl, write_selection


def _web_documents(spark: SparkSession, sf_dir: str) -> str:
    """Embedded documents as they lie on disk, with metadata of their own and an older score."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text", "lang", "source")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    flat = docs.join(vectors, "vec_id").select(
        F.col("vec_id").cast("string").alias("id"),
        "text",
        "lang",
        F.concat(F.lit("https://example.org/"), "source").alias("url"),
        F.lit(0.5).alias("quality_score"),
        (F.col("vec_id") % 4).alias("minhash_cluster_size"),
        F.array("embedding").alias("embeddings"),
    )
    path = scratch_path(spark, "web")
    write_documents(nest_metadata(flat), path)
    return path


@query(f"""WITH {MLP_CTE}, {WORDS_CTE}, t AS (
    SELECT quantile_cont(s, 0.75::DOUBLE) AS thr FROM scored WHERE vec_id IN (SELECT doc_id FROM documents)),
  kept AS (SELECT vec_id, s FROM scored, t WHERE s > thr AND vec_id IN (SELECT doc_id FROM documents))
  SELECT doc_id::VARCHAR AS id, 'https://example.org/' || source AS url, round(s, 6) AS quality_score,
    unnest(range(1, CASE doc_id % 4 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 1 END + 1))::INT AS copy_no, len(words)::INT AS n_tokens
  FROM kept JOIN worded ON doc_id = vec_id""")
def selected_then_tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read, score, write, read, tokenize: all metadata is still there at the end."""
    docs = read_documents(spark, _web_documents(spark, sf_dir))
    selection = select_top(docs, small_network(), F.col("embeddings")[0], retention=0.25)
    kept, _ = write_selection(selection, scratch_path(spark, "selected"))
    again = settle(read_documents(spark, kept))
    tokens = tokenize(again, "id", cluster_size=F.col("minhash_cluster_size")).select("id", "copy_no", "n_tokens")
    return tokens.join(again.select("id", "url", F.round("quality_score", 6).alias("quality_score")), "id")


@query("""SELECT vec_id::VARCHAR AS id, list_transform(embedding, lambda x: round(x::DOUBLE, 5)) AS embedding,
    CASE WHEN label = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label FROM embeddings""")
def jsonl_to_labelled_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled JSONL, where the label stands outside the metadata, embedded, written and read for training."""
    vectors = table(spark, sf_dir, "embeddings")
    samples = vectors.select(
        F.col("vec_id").cast("string").alias("id"),
        F.lit("text").alias("text"),
        F.when(F.col("label") == 1, "positive").otherwise("negative").alias("label"),
    )
    source, out = scratch_path(spark, "labelled-jsonl"), scratch_path(spark, "embedded")
    write_jsonl(samples, source)
    read = read_documents(spark, source, "jsonl").drop("embeddings")
    own = vectors.select(F.col("vec_id").cast("string").alias("id"), F.array("embedding").alias("embeddings"))
    write_documents(nest_metadata(read.join(own, "id")), out)
    rounded = F.transform("embedding", lambda x: F.round(x.cast("double"), 5))
    return read_labelled_embeddings(spark, out).select("id", rounded.alias("embedding"), "label")


# Every order key five times and more: l_orderkey alone is no key of lineitem.
@query("""WITH r AS (SELECT l_orderkey, count(*) AS there,
    sum(count(*)) OVER (ORDER BY md5('42:' || l_orderkey)) AS upto FROM lineitem GROUP BY l_orderkey)
  SELECT l_orderkey, (CASE WHEN upto <= 10001 THEN there ELSE 10001 - (upto - there) END)::BIGINT AS n
  FROM r WHERE upto - there < 10001""")
def exact_sample_of_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly n rows although keys repeat; counted per key, since equal keys are interchangeable."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    return S.sample_n(rows, 10_001, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT l_returnflag, l_orderkey, count(*) AS there,
    sum(count(*)) OVER (PARTITION BY l_returnflag ORDER BY md5('42:' || l_orderkey)) AS upto FROM lineitem GROUP BY l_returnflag, l_orderkey)
  SELECT l_returnflag, l_orderkey, (CASE WHEN upto <= 777 THEN there ELSE 777 - (upto - there) END)::BIGINT AS n
  FROM r WHERE upto - there < 777""")
def quota_of_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_quantity")
    taken = S.sample_per_group(rows, ["l_returnflag"], 777, "l_orderkey")
    return taken.groupBy("l_returnflag", "l_orderkey").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, unnest(range(1, CASE doc_id % 3 WHEN 0 THEN 3 ELSE 1 END + 1))::INT AS copy_no FROM documents""")
def rehydrated_with_missing_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document without a cluster size stays, once."""
    size = F.when(F.col("doc_id") % 3 == 0, 3).when(F.col("doc_id") % 3 == 1, 1)
    return rehydrate(table(spark, sf_dir, "documents").select("doc_id"), size).select("doc_id", "copy_no")


@query("""SELECT l_returnflag, round(quantile_cont(s, 0.9::DOUBLE), 4) AS threshold, count(*) AS n_sample FROM (
    SELECT l_returnflag, CASE WHEN l_orderkey = 1 THEN 1e15::DOUBLE ELSE l_extendedprice::DOUBLE / 1e6 END AS s FROM lineitem)
  GROUP BY l_returnflag""")
def threshold_with_outlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A few scores far from all others do not blur the histogram of the rest."""
    score = F.when(F.col("l_orderkey") == 1, 1e15).otherwise(F.col("l_extendedprice").cast("double") / 1e6)
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", score.alias("score"))
    found = corpus_threshold(rows, "score", 0.1, ["l_returnflag"])
    return found.select("l_returnflag", F.round("threshold", 4).alias("threshold"), "n_sample")


@query(f"""WITH RECURSIVE {FOREST_CTE.replace("forest AS", "plain AS")},
forest AS (SELECT lang, message_id, parent_id, CASE WHEN length(text) % 2 = 0 THEN text || ' edited' ELSE text END AS text FROM plain),
{_LEAVES},
walk AS (
  SELECT lang, message_id AS leaf_id, message_id AS node, parent_id, 0 AS height, [message_id] AS seen, text FROM leaf
  UNION ALL
  SELECT w.lang, w.leaf_id, m.message_id, m.parent_id, w.height + 1, list_append(w.seen, m.message_id), m.text
  FROM walk w JOIN forest m ON m.lang = w.lang AND m.message_id = w.parent_id
  WHERE NOT list_contains(w.seen, m.message_id)),
ends AS (
  SELECT w.lang, w.leaf_id, w.node AS root_id FROM walk w
  WHERE NOT EXISTS (SELECT 1 FROM forest m WHERE m.lang = w.lang AND m.message_id = w.parent_id)),
thread AS (
  SELECT e.lang, e.root_id, e.leaf_id, string_agg(w.text, ' ' ORDER BY w.height DESC) AS text
  FROM ends e JOIN walk w ON w.lang = e.lang AND w.leaf_id = e.leaf_id GROUP BY ALL)
SELECT lang AS code, leaf_id AS sample_id, text FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, root_id ORDER BY md5('42:' || leaf_id)) AS r FROM thread) WHERE r <= 2""")
def conversation_samples_with_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some messages come twice; the later one counts."""
    from curate.sources.samples import conversation_samples

    forest = message_forest(spark, sf_dir).withColumn("version", F.lit(1))
    edited = forest.where(F.length("text") % 2 == 0).withColumns(
        {"text": F.concat("text", F.lit(" edited")), "version": F.lit(2)}
    )
    return conversation_samples(forest.unionByName(edited), order=F.col("version"))


@query(f"""WITH {_TOKENS_CTE}, keyed AS (SELECT doc_id::VARCHAR AS id, copy_no, n_tokens FROM copies)
  SELECT id, copy_no, n_tokens,
    (coalesce(sum(n_tokens) OVER (ORDER BY id, copy_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {_SHARD})::INT AS shard
  FROM keyed""")
def token_shard_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with text keys: tokenized, cut into shards, written, and read back."""
    docs = table(spark, sf_dir, "documents").withColumn("id", F.col("doc_id").cast("string"))
    path = scratch_path(spark, "shards")
    write_token_shards(docs, "id", path, cluster_size=_boundary_size(), budget=_SHARD)
    return read_shards(spark, path).select("id", "copy_no", "n_tokens", "shard")


@query(f"""{_MIXTURE_CTE}, {SPLIT_CTE.format(by='lang', rows='mixture')}, parts AS (
    SELECT lang, label, unnest(['all', 'train', 'valid', 'test']) AS part, unnest([total, train, valid, rest - valid]) AS n FROM sizes)
  SELECT part, lang, label, n::BIGINT AS n FROM parts WHERE lang <> 'de' AND n > 0""")
def labelled_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four outputs of every language that was not finished before; one of them was."""
    root = scratch_path(spark, "dataset")
    docs = table(spark, sf_dir, "documents")
    for part in ("all", "train", "valid", "test"):
        write_documents(docs.where("false").select(F.lit("de").alias("lang")), f"{root}/de/{part}")
    web = docs.select("lang", F.col("doc_id").alias("sample_id"), "text")
    todo = build_dataset(spark, root, mapping_table(spark, sf_dir), source_tables(spark, sf_dir), web, NUM_SAMPLES)
    paths = [(part, f"{root}/{lang}/{part}") for lang in todo for part in ("all", "train", "valid", "test")]
    found = None
    for part, path in paths:
        rows = spark.read.parquet(path).select(F.lit(part).alias("part"), "lang", "label")
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy("part", "lang", "label").agg(F.count("*").alias("n"))


@query(f"WITH {LABELLED_CTE} SELECT '__label__' || label || ' ' || {V1} AS value FROM labelled")
def lines_of_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = labelled_documents(spark, sf_dir).select("label", "text")
    source, root = scratch_path(spark, "samples"), scratch_path(spark, "lines")
    write_jsonl(samples, source)
    lines_from_jsonl(spark, source, root, "xx")
    return spark.read.text(root).select("value")


@query(f"""WITH {LABELLED_CTE}, l AS (SELECT 'all' AS everything, * FROM labelled), {SPLIT_CTE.format(by='everything', rows='l')}
  SELECT side, unnest(range(1, least(25, rest) + 1))::INT AS rank, true AS in_order
  FROM (SELECT * FROM sizes WHERE label = 'negative'), (SELECT unnest(['high', 'low']) AS side)""")
def trained_and_inspected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classifier trained on one part, and the negatives of the rest that it scores highest and lowest."""
    samples = labelled_documents(spark, sf_dir).withColumn("all", F.lit("all"))
    split = settle(S.stratified_split(samples, ["all"], "label", "doc_id"))
    _, found = train_and_inspect(split.where("split = 'train'"), None, split.where("split <> 'train'"), "doc_id")
    before = F.lag("score").over(S.W.partitionBy("side").orderBy("rank"))
    order = F.when(F.col("side") == "high", before >= F.col("score")).otherwise(before <= F.col("score"))
    return found.select("side", "rank", F.coalesce(order, F.lit(True)).alias("in_order"))
