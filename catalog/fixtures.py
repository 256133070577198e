"""Input tables of the queries, derived from the test tables in Spark and again in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import table

# SQL common table expressions, to be joined with commas.
LABELLED_CTE = """
labelled AS (
  SELECT d.doc_id, d.lang, d.source, d.text,
         CASE WHEN l.quality = 1 THEN 'positive' ELSE 'negative' END AS label
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
"""

# The 29 white space characters as a class RE2 understands.
WS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^{WS}+', ''), '{WS}+$', '')"


DIRTY_CTE = """
dirty AS (
  SELECT doc_id, lang, CASE
      WHEN doc_id % 5 = 0 THEN replace(text, chr(10), chr(13) || chr(10))
      WHEN doc_id % 7 = 0 THEN chr(160) || chr(12288) || text || chr(28) || chr(8195)
      ELSE text END AS text
  FROM documents)
"""

PAIRS_CTE = """
pairs AS (
  SELECT u.conv_id * 100 + u.turn AS pair_id, u.conv_id,
         CASE u.conv_id % 4 WHEN 0 THEN 'fra' WHEN 1 THEN 'deu' WHEN 2 THEN 'spa' ELSE 'eng' END AS language_code,
         u.text AS inputs,
         a.text || CASE WHEN u.conv_id % 7 = 0 THEN ' <unk>' ELSE '' END
                || CASE WHEN u.conv_id % 3 = 0 THEN '...' ELSE '' END AS targets
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')
"""

CHOICES_CTE = """
choices AS (
  SELECT item_id, text AS question,
         [substr(text, 1 + k * ((length(text) + 3) // 4), (length(text) + 3) // 4) for k in range(0, 4)] AS choices,
         item_id % 5 AS answer,
         CASE item_id % 4 WHEN 0 THEN 'fra' WHEN 1 THEN 'deu' WHEN 2 THEN 'spa' ELSE 'eng' END AS language
  FROM benchmark)
"""

LETTERED_CTE = """
lettered AS (
  SELECT item_id, '  ' || text || ' ' AS "Question",
         CASE WHEN item_id % 11 = 0 THEN NULL ELSE ' ' || substr('ABCDE', (item_id % 5 + 1)::INT, 1) END AS "Answer",
         substr(text, 1 + 0 * ((length(text) + 3) // 4), (length(text) + 3) // 4) AS "A",
         substr(text, 1 + 1 * ((length(text) + 3) // 4), (length(text) + 3) // 4) AS "B",
         substr(text, 1 + 2 * ((length(text) + 3) // 4), (length(text) + 3) // 4) AS "C",
         substr(text, 1 + 3 * ((length(text) + 3) // 4), (length(text) + 3) // 4) AS "D", language
  FROM choices_lang)
"""

# Forest: turns are chains; even turns of even conversations get two more leaves; every third
# conversation switches language at turn 2; a third of the conversations of a language hang off one
# hot root; some conversations get a cycle with messages leading into it.
FOREST_CTE = """
base AS (
  SELECT conv_id, turn, text,
         CASE WHEN conv_id % 3 = 0 AND turn = 2 THEN 'xx'
              ELSE CASE conv_id % 4 WHEN 0 THEN 'fr' WHEN 1 THEN 'de' WHEN 2 THEN 'es' ELSE 'en' END END AS lang
  FROM conversations),
forest AS (
  SELECT lang, (conv_id * 100 + turn)::VARCHAR AS message_id,
         CASE WHEN turn = 0 THEN CASE WHEN conv_id % 3 = 1 THEN 'hub' ELSE NULL END
              ELSE (conv_id * 100 + turn - 1)::VARCHAR END AS parent_id, text FROM base
  UNION ALL
  SELECT lang, (conv_id * 100 + turn + x)::VARCHAR, (conv_id * 100 + turn - 1)::VARCHAR, text || ' +' || x
  FROM base, (SELECT unnest([50, 70]) AS x) WHERE turn > 0 AND turn % 2 = 0 AND conv_id % 2 = 0
  UNION ALL
  SELECT DISTINCT lang, 'hub', '', 'hub of ' || lang FROM base WHERE turn = 0 AND conv_id % 3 = 1
  UNION ALL
  SELECT lang, 'loop' || conv_id || '_' || turn, 'loop' || conv_id || '_' || ((turn + 1) % 3), text
  FROM base WHERE conv_id % 9 = 4 AND turn < 3
  UNION ALL
  SELECT lang, 'tail' || conv_id || '_' || turn, 'loop' || conv_id || '_0', text
  FROM base WHERE conv_id % 9 = 4 AND turn < 2)
"""


def dirty_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with carriage returns, and foreign white space at both ends."""
    docs = table(spark, sf_dir, "documents")
    text = (
        F.when(F.col("doc_id") % 5 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n")))
        .when(
            F.col("doc_id") % 7 == 0,
            F.concat(F.lit("\u00a0\u3000"), "text", F.lit("\u001c\u2003")),
        )
        .otherwise(F.col("text"))
    )
    return docs.select("doc_id", "lang", text.alias("text"))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a quality label: the small label table joins on its key."""
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", F.when(F.col("quality") == 1, "positive").otherwise("negative").alias("label")
    )
    docs = table(spark, sf_dir, "documents")
    return docs.join(labels, "doc_id").select("doc_id", "lang", "source", "text", "label")


def _language(number):
    names = F.array(*[F.lit(name) for name in ("fra", "deu", "spa", "eng")])
    return F.element_at(names, (number % 4 + 1).cast("int"))


def instruction_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with the assistant turn that follows."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("inputs"))
    answered = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    conv = F.col("conv_id")
    targets = F.concat(
        "answer",
        F.when(conv % 7 == 0, " <unk>").otherwise(""),
        F.when(conv % 3 == 0, "...").otherwise(""),
    )
    return asked.join(answered, ["conv_id", "turn"]).select(
        (conv * 100 + F.col("turn")).alias("pair_id"),
        "conv_id",
        _language(conv).alias("language_code"),
        "inputs",
        targets.alias("targets"),
    )


def choice_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with four choices, the quarters of their text, and a one-based answer; 0 stands for the last choice."""
    items = table(spark, sf_dir, "benchmark")
    quarter = F.ceil(F.length("text") / 4).cast("int")
    choices = F.array(*[F.substring(F.col("text"), F.lit(1) + F.lit(k) * quarter, quarter) for k in range(4)])
    return items.select(
        "item_id",
        F.col("text").alias("question"),
        choices.alias("choices"),
        (F.col("item_id") % 5).alias("answer"),
        _language(F.col("item_id")).alias("language"),
    )


def lettered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same questions in column form; E has no column, some keys are missing."""
    item = F.col("item_id")
    letter = F.substring(F.lit("ABCDE"), (item % 5 + 1).cast("int"), F.lit(1))
    return choice_items(spark, sf_dir).select(
        "item_id",
        F.concat(F.lit("  "), "question", F.lit(" ")).alias("Question"),
        F.when(item % 11 == 0, None).otherwise(F.concat(F.lit(" "), letter)).alias("Answer"),
        *[F.col("choices")[i].alias(name) for i, name in enumerate("ABCD")],
        "language",
    )


def message_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(lang, message_id, parent_id, text): chains, branches, a hot root, language switches, a cycle."""
    conv, turn = F.col("conv_id"), F.col("turn")
    two = F.element_at(F.array(*[F.lit(x) for x in ("fr", "de", "es", "en")]), (conv % 4 + 1).cast("int"))
    base = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "text", F.when((conv % 3 == 0) & (turn == 2), "xx").otherwise(two).alias("lang")
    )
    number = conv * 100 + turn
    first = F.when(conv % 3 == 1, "hub")
    chain = base.select(
        "lang",
        number.cast("string").alias("message_id"),
        F.when(turn == 0, first).otherwise((number - 1).cast("string")).alias("parent_id"),
        "text",
    )
    extra = base.where((turn > 0) & (turn % 2 == 0) & (conv % 2 == 0)).withColumn(
        "x", F.explode(F.array(F.lit(50), F.lit(70)))
    )
    branch = extra.select(
        "lang",
        (number + F.col("x")).cast("string"),
        (number - 1).cast("string"),
        F.concat("text", F.lit(" +"), F.col("x").cast("string")),
    )
    hub = base.where((turn == 0) & (conv % 3 == 1)).select("lang").distinct()
    hubs = hub.select("lang", F.lit("hub"), F.lit(""), F.concat(F.lit("hub of "), "lang"))
    start = base.where(conv % 9 == 4)

    def name(prefix: str, position):
        return F.concat(F.lit(prefix), conv.cast("string"), F.lit("_"), position.cast("string"))

    loop = start.where(turn < 3).select("lang", name("loop", turn), name("loop", (turn + 1) % 3), "text")
    tail = start.where(turn < 2).select("lang", name("tail", turn), name("loop", F.lit(0)), "text")
    return chain.union(branch).union(hubs).union(loop).union(tail)
