"""Labelled training mixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.fixtures import (
    CHOICES_CTE,
    LETTERED_CTE,
    PAIRS_CTE,
    choice_items,
    instruction_pairs,
    lettered_items,
    message_forest,
    sql_strip,
)
from catalog.registry import query, table
from catalog.sampling import SPLIT_CTE, with_positions
from catalog.texts import _PAIR_TEXT, _PICK
from catalog.threads import CAPPED_CTE
from curate.operators.metrics import dataset_counts, dataset_totals
from curate.plans.mixture import (
    Source,
    build_mixture,
    mapped_sources,
    shuffle_mixture,
    split_mixture,
    unpivot_mapping,
)
from curate.session import settle
from curate.sources.samples import (
    collection_samples,
    conversation_samples,
    indexed_choice_samples,
    instruction_samples,
    lettered_choice_samples,
)

NUM_SAMPLES = 60
SOURCES = ("letters", "exam", "chat", "human", "collection")

_MAPPING_CTE = """
codes AS (
  SELECT DISTINCT lang, CASE lang WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' WHEN 'es' THEN 'spa' ELSE 'eng' END AS code
  FROM documents),
mapping AS (
  SELECT lang, 'letters' AS source, code FROM codes WHERE lang <> 'de'
  UNION ALL SELECT lang, 'exam', code FROM codes WHERE lang <> 'es'
  UNION ALL SELECT lang, 'chat', lang FROM codes
  UNION ALL SELECT lang, 'human', code FROM codes WHERE lang <> 'fr'
  UNION ALL SELECT lang, 'collection', code FROM codes)
"""
_SOURCES_CTE = f"""{CAPPED_CTE}, {_MAPPING_CTE}, {PAIRS_CTE}, {CHOICES_CTE},
choices_lang AS (SELECT item_id, question AS text, language FROM choices), {LETTERED_CTE},
raw AS (
  SELECT 'letters' AS source, language AS code, item_id::VARCHAR AS sample_id, {sql_strip('"Question"')} || ' ' ||
      coalesce({sql_strip('''CASE ''' + sql_strip('''coalesce("Answer", '')''') + ''' WHEN 'A' THEN "A" WHEN 'B' THEN "B"
        WHEN 'C' THEN "C" WHEN 'D' THEN "D" END''')}, '') AS text FROM lettered
  UNION ALL SELECT 'exam', language, item_id::VARCHAR, question || ' ' || {_PICK} FROM choices
  UNION ALL SELECT 'chat', lang, leaf_id, text FROM capped
  UNION ALL SELECT 'human', language_code, pair_id::VARCHAR, {_PAIR_TEXT} FROM pairs
  UNION ALL SELECT 'collection', language_code, pair_id::VARCHAR, {_PAIR_TEXT} FROM pairs
      WHERE NOT contains({_PAIR_TEXT}, '<unk>')),
mapped AS (
  SELECT m.lang, m.source, r.sample_id, r.text FROM raw r JOIN mapping m ON m.source = r.source AND m.code = r.code)
"""
_MIXTURE_CTE = f"""{_SOURCES_CTE},
available AS (
  SELECT lang, source, sample_id, text FROM mapped
  UNION ALL SELECT lang, 'web', doc_id::VARCHAR, text FROM documents),
counted AS (
  SELECT lang, source, count(*) AS total FROM available WHERE text <> '' GROUP BY ALL),
fixed AS (
  SELECT *, CASE WHEN source IN ('letters', 'exam', 'chat') THEN least(total, {NUM_SAMPLES})
      WHEN source = 'human' THEN total END AS take FROM counted),
filled AS (
  SELECT lang, source, total, CASE WHEN source = 'collection' THEN
      least(total, greatest({NUM_SAMPLES} - coalesce(sum(take) OVER (PARTITION BY lang), 0), 0)) ELSE take END AS take FROM fixed),
quota AS (
  SELECT lang, source, CASE WHEN source = 'web' THEN coalesce(sum(take) OVER (PARTITION BY lang), 0) ELSE take END AS n FROM filled),
mixture AS (
  SELECT lang, source, sample_id, CASE WHEN source = 'web' THEN 'negative' ELSE 'positive' END AS label, text FROM (
    SELECT a.*, q.n, row_number() OVER (PARTITION BY a.lang, a.source ORDER BY md5('42:' || a.sample_id)) AS r
    FROM available a JOIN quota q ON a.lang = q.lang AND a.source = q.source WHERE a.text <> '') WHERE r <= n)
"""


def mapping_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per language of the documents, with gaps in the coverage of the sources."""
    lang = F.col("lang")
    code = F.when(lang == "fr", "fra").when(lang == "de", "deu").when(lang == "es", "spa").otherwise("eng")
    langs = table(spark, sf_dir, "documents").select("lang").distinct()
    return langs.select(
        "lang",
        F.when(lang != "de", code).alias("letters"),
        F.when(lang != "es", code).alias("exam"),
        lang.alias("chat"),
        F.when(lang != "fr", code).alias("human"),
        code.alias("collection"),
    )


def source_tables(spark: SparkSession, sf_dir: str) -> dict[str, Source]:
    items, pairs = choice_items(spark, sf_dir), instruction_pairs(spark, sf_dir)
    exam, _ = indexed_choice_samples(items, F.col("item_id"), F.col("language"))
    key, code = F.col("pair_id"), F.col("language_code")
    # Threads cost several joins; written once, they can be counted and read again.
    chat = settle(conversation_samples(message_forest(spark, sf_dir)))
    return {
        "letters": Source(
            lettered_choice_samples(lettered_items(spark, sf_dir), F.col("item_id"), F.col("language"))
        ),
        "exam": Source(exam),
        "chat": Source(chat),
        "human": Source(instruction_samples(pairs, key, code), "all"),
        "collection": Source(collection_samples(pairs, key, code), "rest"),
    }


def _mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    web = table(spark, sf_dir, "documents").select("lang", F.col("doc_id").alias("sample_id"), "text")
    return build_mixture(
        mapping_table(spark, sf_dir), source_tables(spark, sf_dir), web, NUM_SAMPLES
    )


@query(f"WITH {_MAPPING_CTE} SELECT * FROM mapping")
def source_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpivot_mapping(mapping_table(spark, sf_dir), list(SOURCES))


@query(f"{_SOURCES_CTE} SELECT * FROM mapped")
def union_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapped_sources(mapping_table(spark, sf_dir), source_tables(spark, sf_dir))


@query(f"""{_MIXTURE_CTE} SELECT *,
    row_number() OVER (ORDER BY lang, md5('42:' || source || ':' || sample_id))::BIGINT AS position FROM mixture""")
def training_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture in its seeded order, written; the position of a row is its place in the files."""
    return with_positions(spark, shuffle_mixture(_mixture(spark, sf_dir)), "mixture")


@query(f"""{_MIXTURE_CTE}, {SPLIT_CTE.format(by='lang', rows='mixture')}
    SELECT lang, source, sample_id, label, CASE WHEN r <= train THEN 'train' WHEN r <= train + valid THEN 'valid' ELSE 'test' END AS split
    FROM (SELECT l.*, s.train, s.valid,
        row_number() OVER (PARTITION BY l.lang, l.label ORDER BY md5('42:' || l.source || ':' || l.sample_id)) AS r
      FROM mixture l JOIN sizes s ON l.lang = s.lang AND l.label = s.label)""")
def training_mixture_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixture = settle(_mixture(spark, sf_dir))
    return split_mixture(mixture).select("lang", "source", "sample_id", "label", "split")


@query(f"{_MIXTURE_CTE} SELECT lang, source, label, count(*) AS n FROM mixture GROUP BY ALL")
def mixture_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset_counts(_mixture(spark, sf_dir), ["lang", "source", "label"])


@query(f"{_MIXTURE_CTE} SELECT lang, label, count(*) AS n FROM mixture GROUP BY ROLLUP (lang, label)")
def mixture_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset_totals(_mixture(spark, sf_dir), ["lang", "label"])
