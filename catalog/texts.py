"""Sample assembly, text cleaning and predicates."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.fixtures import (
    CHOICES_CTE,
    DIRTY_CTE,
    LABELLED_CTE,
    LETTERED_CTE,
    PAIRS_CTE,
    WS,
    choice_items,
    dirty_documents,
    instruction_pairs,
    labelled_documents,
    lettered_items,
    sql_strip,
)
from catalog.registry import query, table
from curate.functions import text as T
from curate.sources.samples import (
    collection_samples,
    indexed_choice_samples,
    instruction_samples,
    lettered_choice_samples,
    text_samples,
)
from curate.sources.sinks import drop_empty, fasttext_lines, partition_label_only

V1 = f"lower({sql_strip('replace(text, chr(10), chr(32))')})".replace("chr(32)", "''")
V2 = f"lower({sql_strip(f'''regexp_replace(text, '{WS}+', ' ', 'g')''')})"
_MARKED = r"regexp_replace(text, '\r?\n', ' <NEW_LINE> ', 'g')"
V3 = f"lower({sql_strip(f'''regexp_replace({_MARKED}, '{WS}+', ' ', 'g')''')})"


@query(f"WITH {LABELLED_CTE} SELECT doc_id, label, text FROM labelled")
def label_tagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_documents(spark, sf_dir).select("doc_id", "label", "text")


_PAIR_TEXT = """inputs || ' ' || CASE WHEN targets LIKE '%...' THEN left(targets, length(targets) - 3)
  ELSE targets END"""


@query(f"""WITH {PAIRS_CTE} SELECT language_code AS code, pair_id AS sample_id, {_PAIR_TEXT} AS text FROM pairs""")
def instruction_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = instruction_pairs(spark, sf_dir)
    return instruction_samples(pairs, F.col("pair_id"), F.col("language_code"))


@query(
    f"""WITH {PAIRS_CTE}, built AS (SELECT language_code AS code, pair_id AS sample_id, {_PAIR_TEXT} AS text FROM pairs)
    SELECT * FROM built WHERE NOT contains(text, '<unk>')"""
)
def unknown_token_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = instruction_pairs(spark, sf_dir)
    return collection_samples(pairs, F.col("pair_id"), F.col("language_code"))


_PICK = "choices[CASE WHEN answer >= 1 THEN answer ELSE answer + 4 END]"


@query(f"""WITH {CHOICES_CTE} SELECT language AS code, item_id AS sample_id,
    question || ' ' || {_PICK} AS text FROM choices""")
def numbered_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples, _ = indexed_choice_samples(
        choice_items(spark, sf_dir), F.col("item_id"), F.col("language")
    )
    return samples


@query(f"""WITH {CHOICES_CTE} SELECT language AS code, item_id AS sample_id,
    question || ' ' || {_PICK} AS text FROM choices WHERE language = 'deu'""")
def numbered_choice_of_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = choice_items(spark, sf_dir).where(F.col("language") == "deu")
    samples, _ = indexed_choice_samples(items, F.col("item_id"), F.col("language"))
    return samples


@query(f"""WITH {CHOICES_CTE}, choices_lang AS (SELECT item_id, question AS text, language FROM choices), {LETTERED_CTE}
    SELECT language AS code, item_id AS sample_id, {sql_strip('"Question"')} || ' ' ||
      coalesce({sql_strip('''CASE ''' + sql_strip('''coalesce("Answer", '')''') + ''' WHEN 'A' THEN "A" WHEN 'B' THEN "B"
        WHEN 'C' THEN "C" WHEN 'D' THEN "D" END''')}, '') AS text FROM lettered""")
def lettered_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lettered_choice_samples(lettered_items(spark, sf_dir), F.col("item_id"), F.col("language"))


@query("SELECT lang AS code, doc_id AS sample_id, text FROM documents")
def plain_text_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_samples(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("lang"))


def _cleaned(spark: SparkSession, sf_dir: str, version: str) -> DataFrame:
    docs = dirty_documents(spark, sf_dir)
    return docs.select("doc_id", T.clean(F.col("text"), version).alias("text"))


@query(f"WITH {DIRTY_CTE} SELECT doc_id, {V1} AS text FROM dirty")
def clean_text_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir, "V1")


@query(f"WITH {DIRTY_CTE} SELECT doc_id, {V2} AS text FROM dirty")
def clean_text_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir, "V2")


@query(f"WITH {DIRTY_CTE} SELECT doc_id, {V3} AS text FROM dirty")
def clean_text_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir, "V3")


@query(f"""WITH {LABELLED_CTE} SELECT 'V2' AS version, lang, 'train' AS split,
    '__label__' || label || ' ' || {V2} AS value FROM labelled""")
def fasttext_line_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = labelled_documents(spark, sf_dir).withColumn("split", F.lit("train"))
    return fasttext_lines(samples, "V2")


# The standard's own table, apart from the one under test.
_NAMED = ", ".join(
    f"'&{name}': {' || '.join(f'chr({ord(c)})' for c in char)}" for name, char in html5.items() if name.endswith(";") and name not in ("amp;", "AMP;")
)
# Pages without their tags, with some damage added: numeric references, escape sequences, control
# characters and disguised Windows-1252 characters.
_DAMAGED = r"""
damaged AS (
  SELECT page_id, CASE page_id % 4
      WHEN 0 THEN html
      WHEN 1 THEN plain || '&#8364; &#x1F600; &amp;amp;lt; &unknown; &#38;#65; &eacute;&ntilde;&ouml; &#0000000065; &NotEqualTilde;'
      WHEN 2 THEN chr(27) || '[31m' || plain || chr(27) || '[0m' || chr(147) || 'x' || chr(148) || chr(7)
      ELSE plain || chr(10) || 'a < b &copy;' END AS text
  FROM (SELECT page_id, html, regexp_replace(html, '<[^>]*>', '', 'g') AS plain FROM pages))
"""
_REPAIR_SQL = rf"""WITH {_DAMAGED},
headed AS (
  SELECT page_id, text, CASE WHEN contains(text, '<')
      THEN regexp_extract(split_part(text, '<', 1), '(?s)^(.*\n)?', 1) ELSE text END AS head FROM damaged),
folded AS (
  SELECT page_id, substr(text, length(head) + 1) AS tail,
    regexp_replace(head, '&(?:(?:amp|AMP|#0*38|#[xX]0*26);)+', '&', 'g') AS head FROM headed),
tokens AS (
  SELECT page_id, tail, regexp_extract_all(head, '&#?[0-9a-zA-Z]+;|[^&]+|&') AS parts FROM folded),
decoded AS (
  SELECT page_id, tail, coalesce(array_to_string(list_transform(parts, lambda t: CASE
      WHEN regexp_matches(t, '^&#[0-9]+;$') THEN chr(regexp_extract(t, '[0-9]+')::INT)
      WHEN regexp_matches(t, '^&#[xX][0-9a-fA-F]+;$') THEN chr(('0x' || regexp_extract(t, '^&#[xX](.*);$', 1))::INT)
      ELSE coalesce(map_extract_value(MAP {{{_NAMED}}}, t), t) END), ''), '') || tail AS text FROM tokens)
SELECT page_id, regexp_replace(regexp_replace(
    replace(replace(text, chr(147), chr(8220)), chr(148), chr(8221)),
    '\x1b\[[0-9;]*[A-Za-z]', '', 'g'),
    '[\x00-\x08\x0b\x0e-\x1f\x7f\x{{206a}}-\x{{206f}}\x{{feff}}\x{{fff9}}-\x{{fffc}}]', '', 'g') AS text
FROM decoded"""


@query(_REPAIR_SQL)
def markup_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.regexp_replace("html", "<[^>]*>", "")
    page = F.col("page_id") % 4
    text = (
        F.when(page == 0, F.col("html"))
        .when(page == 1, F.concat(plain, F.lit("&#8364; &#x1F600; &amp;amp;lt; &unknown; &#38;#65; &eacute;&ntilde;&ouml; &#0000000065; &NotEqualTilde;")))
        .when(page == 2, F.concat(F.lit("\x1b[31m"), plain, F.lit("\x1b[0m\u0093x\u0094\x07")))
        .otherwise(F.concat(plain, F.lit("\na < b &copy;")))
    )
    return table(spark, sf_dir, "pages").select("page_id", T.repair(text).alias("text"))


@query("SELECT doc_id, text FROM documents WHERE lang = 'fr'")
def language_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("lang") == "fr").select("doc_id", "text")


@query(f"WITH {LABELLED_CTE} SELECT doc_id, lang, text FROM labelled WHERE label = 'negative'")
def label_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = labelled_documents(spark, sf_dir)
    return labelled.where(F.col("label") == "negative").select("doc_id", "lang", "text")


_LINES_CTE = f"""
{LABELLED_CTE}, lines AS (
  SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN ' __LABEL__' || label || ' '
      WHEN 1 THEN '__label__' || label ELSE '__label__' || label || ' ' || text END AS value
  FROM labelled)
"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = labelled_documents(spark, sf_dir)
    return labelled.select(
        "doc_id",
        F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit(" __LABEL__"), "label", F.lit(" ")))
        .when(F.col("doc_id") % 6 == 1, F.concat(F.lit("__label__"), "label"))
        .otherwise(F.concat(F.lit("__label__"), "label", F.lit(" "), "text"))
        .alias("value"),
    )


@query(rf"""WITH {_LINES_CTE} SELECT doc_id, value,
    regexp_matches(value, '(?i)^\s*__label__(positive|negative)\s*$') AS label_only FROM lines""")
def label_only_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = partition_label_only(_lines(spark, sf_dir))
    return good.withColumn("label_only", F.lit(False)).unionByName(bad.withColumn("label_only", F.lit(True)))


@query("""SELECT conv_id, turn, text FROM (SELECT conv_id, turn,
    CASE WHEN role = 'system' THEN NULL WHEN turn = 3 THEN '' ELSE text END AS text FROM conversations)
    WHERE text IS NOT NULL AND text <> ''""")
def empty_text_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    text = F.when(F.col("role") == "system", None).when(F.col("turn") == 3, "").otherwise(F.col("text"))
    good, _ = drop_empty(turns.select("conv_id", "turn", text.alias("text")))
    return good
