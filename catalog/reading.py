"""Scans, sinks and run control. Files are written below the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.fixtures import DIRTY_CTE, LABELLED_CTE, dirty_documents, labelled_documents, sql_strip
from catalog.registry import query, table
from catalog.selecting import MLP_CTE, small_network
from catalog.texts import V1
from curate.plans.select import select_top
from curate.session import scratch_path
from curate.sources.documents import (
    head_of_files,
    prefix_sample,
    read_documents,
    read_file_sample,
    read_labelled_embeddings,
)
from curate.sources.heads import read_heads
from curate.sources.labelled import parse_labelled_lines, read_labelled_jsonl, read_labelled_lines
from curate.sources.mapping import read_mapping
from curate.sources.sinks import (
    finished,
    unfinished,
    write_documents,
    write_fasttext_lines,
    write_jsonl,
)


def nested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with everything but the text nested under ``metadata``."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("id"),
        "text",
        F.struct("lang", (F.col("doc_id") % 12).alias("minhash_cluster_size")).alias("metadata"),
    )


_FLAT = "SELECT doc_id::VARCHAR AS id, text, lang, doc_id % 12 AS minhash_cluster_size FROM documents"


@query(_FLAT)
def parquet_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "parquet")
    write_documents(nested_documents(spark, sf_dir), path)
    return read_documents(spark, path).select("id", "text", "lang", "minhash_cluster_size")


@query(_FLAT)
def jsonl_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "jsonl")
    write_jsonl(nested_documents(spark, sf_dir), path, compressed=True)
    return read_documents(spark, path, "jsonl").select("id", "text", "lang", "minhash_cluster_size")


_DAMAGED_CTE = f"""{LABELLED_CTE}, damaged AS (SELECT *, doc_id % 10 AS kind FROM labelled)"""


def _damaged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines, some blank, some cut in half."""
    samples = labelled_documents(spark, sf_dir)
    line = F.to_json(F.struct("label", "text"))
    kind = F.col("doc_id") % 10
    value = (
        F.when(kind == 3, F.lit("  "))
        .when(kind == 4, F.concat(F.lit('{"label": "'), "label", F.lit('", "text": "cut')))
        .otherwise(line)
    )
    return samples.select("doc_id", value.alias("value"))


def _damaged_jsonl(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "damaged")
    _damaged_lines(spark, sf_dir).select("value").write.text(path)
    return path


@query(f"WITH {_DAMAGED_CTE} SELECT label, text FROM damaged WHERE kind NOT IN (3, 4)")
def labelled_jsonl_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_labelled_jsonl(spark, _damaged_jsonl(spark, sf_dir)).rows


@query(f"""WITH {_DAMAGED_CTE} SELECT '{{"label": "' || label || '", "text": "cut' AS line, 'malformed' AS reason
    FROM damaged WHERE kind = 4""")
def labelled_jsonl_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_labelled_jsonl(spark, _damaged_jsonl(spark, sf_dir)).rejects.select("line", "reason")


_LINE_CTE = f"""{LABELLED_CTE}, lines AS (
  SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN label || ' ' || text WHEN 1 THEN '__label__other ' || text
      WHEN 2 THEN '__label__' || label WHEN 3 THEN '  __label__' || label || '  ' || text || '  '
      ELSE '__label__' || label || ' ' || text END AS line FROM labelled),
split AS (
  SELECT line, {sql_strip('line')} AS s FROM lines),
parsed AS (
  SELECT line, s, strpos(s, ' ') AS p, split_part(s, ' ', 1) AS l FROM split),
reasoned AS (
  SELECT *, CASE WHEN NOT starts_with(s, '__label__') THEN 'no label' WHEN p = 0 THEN 'no text'
      WHEN l NOT IN ('__label__positive', '__label__negative') THEN 'unknown label' END AS reason FROM parsed)
"""


def _label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered_label_lines(spark, sf_dir).select("value")


def _numbered_label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % 8
    whole = F.concat(F.lit("__label__"), "label", F.lit(" "), "text")
    value = (
        F.when(kind == 0, F.concat("label", F.lit(" "), "text"))
        .when(kind == 1, F.concat(F.lit("__label__other "), "text"))
        .when(kind == 2, F.concat(F.lit("__label__"), "label"))
        .when(kind == 3, F.concat(F.lit("  __label__"), "label", F.lit("  "), "text", F.lit("  ")))
        .otherwise(whole)
    )
    return labelled_documents(spark, sf_dir).select("doc_id", value.alias("value"))


@query(f"""WITH {_LINE_CTE} SELECT substr(l, 10) AS label, {sql_strip('substr(s, p + 1)')} AS text
    FROM reasoned WHERE reason IS NULL""")
def labelled_line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_labelled_lines(_label_lines(spark, sf_dir)).rows


@query(f"WITH {_LINE_CTE} SELECT line, reason FROM reasoned WHERE reason IS NOT NULL")
def labelled_line_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_labelled_lines(_label_lines(spark, sf_dir)).rejects


@query(f"""WITH {DIRTY_CTE}, {LABELLED_CTE}, samples AS (
    SELECT l.label, d.text FROM labelled l JOIN dirty d USING (doc_id)),
  pieces AS (SELECT label, string_split({V1}, chr(13)) AS parts FROM samples)
  SELECT label, {sql_strip('parts[1]')} AS text FROM pieces""")
def fasttext_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A carriage return kept by cleaning version V1 ends the line when the file is read."""
    samples = dirty_documents(spark, sf_dir).join(
        labelled_documents(spark, sf_dir).select("doc_id", "label"), "doc_id"
    )
    path = scratch_path(spark, "lines")
    write_fasttext_lines(samples.withColumn("split", F.lit("train")), path, "V1")
    return read_labelled_lines(spark, path).rows


@query("""SELECT lang, CASE WHEN lang = 'en' THEN NULL ELSE upper(lang) || '_' END AS exam,
    CASE WHEN lang = 'fr' THEN NULL ELSE lang END AS chat FROM (SELECT DISTINCT lang FROM documents)""")
def language_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mapping file with padded and blank codes, made from the languages of the documents."""
    langs = table(spark, sf_dir, "documents").select("lang").distinct()
    path = scratch_path(spark, "mapping")
    langs.select(
        F.concat(F.lit(" "), "lang").alias("corpus"),
        F.when(F.col("lang") == "en", "").otherwise(F.concat(F.upper("lang"), F.lit("_ "))).alias("exam_code"),
        F.when(F.col("lang") == "fr", "  ").otherwise(F.col("lang")).alias("chat_code"),
    ).write.csv(path, header=True)
    return read_mapping(spark, path, "corpus", {"exam": "exam_code", "chat": "chat_code"})


def nested_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded documents: label and one vector per chunk under ``metadata``."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("label") == 1, "positive").otherwise("negative")
    return vectors.select(
        F.col("vec_id").cast("string").alias("id"),
        F.lit("").alias("text"),
        F.struct(label.alias("label"), F.array("embedding", F.reverse("embedding")).alias("embeddings")).alias(
            "metadata"
        ),
    )


@query("""SELECT vec_id::VARCHAR AS id, embedding, CASE WHEN label = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label
    FROM embeddings""")
def labelled_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "embedded")
    write_documents(nested_embeddings(spark, sf_dir), path)
    return read_labelled_embeddings(spark, path)


@query("SELECT vec_id::VARCHAR AS id, embedding FROM embeddings")
def first_chunk_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    from curate.functions.vectors import first_chunk

    nested = nested_embeddings(spark, sf_dir)
    return nested.select("id", first_chunk(F.col("metadata.embeddings")).alias("embedding"))


# Rows of a fixture file at most, so that there are more files where tables are larger.
_FILE_ROWS = 1000


def _named_files(spark: SparkSession, rows: DataFrame, key: str, buckets: int, name: str, kind: str = "parquet") -> str:
    """Files whose names and row order SQL can state: the rows with the remainder ``b`` of a range of keys, in their order, in
    ``bucket-b-part-p``. Each file is written by one task, which holds no more than ``_FILE_ROWS`` rows of a unique key."""
    path = scratch_path(spark, name)
    part = F.floor(F.col(key) / (buckets * _FILE_ROWS)).cast("int")
    numbered = rows.withColumns({"_bucket": (F.col(key) % buckets).cast("int"), "_part": part})
    numbered = numbered.repartition("_bucket", "_part").sortWithinPartitions("_bucket", "_part", key)
    if kind == "text":
        numbered = numbered.drop(key)
    numbered.write.partitionBy("_bucket", "_part").format(kind).save(f"{path}-parts")
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(root)
    for status in files.globStatus(hadoop.Path(f"{path}-parts/*/*/part-*")):
        found = status.getPath()
        bucket, part = (str(p.getName()).split("=")[1] for p in (found.getParent().getParent(), found.getParent()))
        files.rename(found, hadoop.Path(f"{path}/bucket-{bucket}-part-{part}.{kind}"))
    return path


def _file_sql(key: str, buckets: int, kind: str = "parquet") -> str:
    return f"'bucket-' || ({key} % {buckets}) || '-part-' || ({key} // {buckets * _FILE_ROWS}) || '.{kind}'"


@query(f"""WITH named AS (SELECT doc_id, text, {_file_sql('doc_id', 8)} AS file FROM documents)
    SELECT doc_id, text FROM named WHERE file IN (SELECT file FROM named GROUP BY file ORDER BY md5('42:' || file) LIMIT 3)""")
def random_file_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_file_sample(spark, _named_files(spark, docs, "doc_id", 8, "files")).select("doc_id", "text")


_HEADS_SQL = f"""WITH named AS (SELECT *, {_file_sql('vec_id', 4)} AS file FROM embeddings),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY vec_id) AS r FROM named)
    SELECT vec_id, embedding FROM ranked WHERE r <= greatest(1, 80 // (SELECT count(DISTINCT file) FROM named))"""


@query(_HEADS_SQL)
def head_of_each_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By Spark's scan, which filters on the row number."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    path = _named_files(spark, vectors, "vec_id", 4, "heads")
    return head_of_files(spark.read.parquet(path), 80).select("vec_id", "embedding")


@query(_HEADS_SQL)
def early_head_of_each_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a reader that stops in each file when it has its rows."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return read_heads(spark, _named_files(spark, vectors, "vec_id", 4, "heads"), 80)


@query(f"""WITH {MLP_CTE},
    named AS (SELECT vec_id, {_file_sql('vec_id', 4)} AS file FROM embeddings),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY vec_id) AS r FROM named),
    t AS (SELECT quantile_cont(s, 0.9::DOUBLE) AS thr FROM scored JOIN ranked USING (vec_id)
      WHERE r <= greatest(1, 200 // (SELECT count(DISTINCT file) FROM named)))
    SELECT vec_id, round(s, 6) AS quality_score FROM scored, t WHERE s > thr""")
def select_by_file_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents above the threshold of the first rows of their files; each document is scored once."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    path = _named_files(spark, vectors, "vec_id", 4, "corpus")
    sample = read_heads(spark, path, 200, ["embedding"])
    kept = select_top(spark.read.parquet(path), small_network(), sample=sample).kept
    return kept.select("vec_id", F.round("quality_score", 6).alias("quality_score"))


def _file_name(column: str = "file") -> F.Column:
    return F.element_at(F.split(column, "/"), -1).alias("file")


@query(f"""WITH {_DAMAGED_CTE}, placed AS (
    SELECT *, {_file_sql('doc_id', 3, 'text')} AS file,
      row_number() OVER (PARTITION BY {_file_sql('doc_id', 3, 'text')} ORDER BY doc_id) AS line_number FROM damaged)
    SELECT file, line_number, 'malformed' AS reason FROM placed WHERE kind = 4""")
def labelled_jsonl_reject_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File and line of every malformed record; blank lines count."""
    path = _named_files(spark, _damaged_lines(spark, sf_dir), "doc_id", 3, "placed", "text")
    return read_labelled_jsonl(spark, path).rejects.select(_file_name(), "line_number", "reason")


@query(f"""WITH {_LINE_CTE}, numbered AS (
    SELECT doc_id, line, {_file_sql('doc_id', 3, 'text')} AS file FROM lines),
  pieces AS (
    SELECT doc_id, file, unnest(string_split(line, chr(10))) AS piece, generate_subscripts(string_split(line, chr(10)), 1) AS i FROM numbered),
  placed AS (
    SELECT *, row_number() OVER (PARTITION BY file ORDER BY doc_id, i) AS line_number, {sql_strip('piece')} AS s FROM pieces),
  cut AS (
    SELECT *, strpos(s, ' ') AS p, split_part(s, ' ', 1) AS l FROM placed)
  SELECT file, line_number, CASE WHEN NOT starts_with(s, '__label__') THEN 'no label' WHEN p = 0 THEN 'no text' ELSE 'unknown label' END AS reason
  FROM cut WHERE NOT starts_with(s, '__label__') OR p = 0 OR l NOT IN ('__label__positive', '__label__negative')""")
def labelled_line_reject_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File and line of every line that is no sample; a text's own line feeds start new lines."""
    path = _named_files(spark, _numbered_label_lines(spark, sf_dir), "doc_id", 3, "places", "text")
    return read_labelled_lines(spark, path).rejects.select(_file_name(), "line_number", "reason")


@query("SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 500")
def prefix_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return prefix_sample(docs, "doc_id", 500)


@query("SELECT DISTINCT lang FROM documents WHERE lang NOT IN ('de', 'en')")
def unfinished_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages without a finished output; those of two are written first."""
    docs = table(spark, sf_dir, "documents")
    root = scratch_path(spark, "runs")
    for lang in ("de", "en"):
        write_documents(docs.where(F.col("lang") == lang), f"{root}/{lang}")
    wanted = docs.select("lang").distinct()
    names = [row["lang"] for row in wanted.collect()]  # one row per language
    return unfinished(wanted, finished(spark, root, names))
