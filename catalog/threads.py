"""Message forests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.fixtures import FOREST_CTE, message_forest
from catalog.registry import query
from curate.operators import conversations as C

_LEAVES = """
leaf AS (
  SELECT f.* FROM forest f WHERE NOT EXISTS (
    SELECT 1 FROM forest p WHERE p.lang = f.lang AND p.parent_id <> '' AND p.parent_id = f.message_id))
"""
_WALK = f"""WITH RECURSIVE {FOREST_CTE}, {_LEAVES},
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
  SELECT e.lang, e.root_id, e.leaf_id, count(*)::INT AS n_messages, string_agg(w.text, ' ' ORDER BY w.height DESC) AS text
  FROM ends e JOIN walk w ON w.lang = e.lang AND w.leaf_id = e.leaf_id GROUP BY ALL)
"""
CAPPED_CTE = f"""{_WALK}, capped AS (
  SELECT * EXCLUDE (r) FROM (
    SELECT *, row_number() OVER (PARTITION BY lang, root_id ORDER BY md5('42:' || leaf_id)) AS r FROM thread)
  WHERE r <= 2)"""


@query(f"WITH {FOREST_CTE}, {_LEAVES} SELECT lang, message_id, text FROM leaf")
def conversation_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.leaves(message_forest(spark, sf_dir)).select("lang", "message_id", "text")


@query(f"{_WALK} SELECT * FROM ends")
def conversation_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = message_forest(spark, sf_dir)
    return C.rooted_leaves(forest, C.ancestry(forest))


@query(f"{_WALK} SELECT * FROM thread")
def conversation_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.threads(message_forest(spark, sf_dir), per_root=None)


@query(f"{CAPPED_CTE} SELECT * FROM capped")
def threads_capped_per_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.threads(message_forest(spark, sf_dir))


@query(f"{_WALK} SELECT lang, root_id, count(*) AS n_threads FROM thread GROUP BY ALL")
def threads_grouped_by_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = message_forest(spark, sf_dir)
    return C.threads_per_root(C.rooted_leaves(forest, C.ancestry(forest)))


@query(f"""WITH {FOREST_CTE}, versions AS (
    SELECT lang, message_id, parent_id, text, 1 AS version FROM forest
    UNION ALL SELECT lang, message_id, NULL, text || ' edited', 2 FROM forest WHERE length(text) % 2 = 0)
    SELECT lang, message_id, parent_id, text FROM (
      SELECT *, row_number() OVER (PARTITION BY lang, message_id ORDER BY version DESC) AS r FROM versions) WHERE r = 1""")
def last_message_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    forest = message_forest(spark, sf_dir).withColumn("version", F.lit(1))
    edited = forest.where(F.length("text") % 2 == 0).select(
        "lang",
        "message_id",
        F.lit(None).cast("string").alias("parent_id"),
        F.concat("text", F.lit(" edited")).alias("text"),
        F.lit(2).alias("version"),
    )
    return C.latest_messages(forest.unionByName(edited), F.col("version"))
