"""The pipeline's stages, one after the other, against what each must do alone."""

import random

import corpus_pipeline
from curate.llm import language, near_dups, quality

from test_near import expected, shingles

SF_DIR = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    extra = docs.limit(1).selectExpr("-1L as doc_id", "'1234 -- 5678' as text", "lang", "source", "12L as n_chars")
    twin = docs.orderBy("doc_id").limit(1).selectExpr("doc_id + 100000 as doc_id", "text", "lang", "source", "n_chars")
    key = docs.orderBy("doc_id").limit(1).selectExpr("200000L as doc_id", "concat(text, ' Those who know say more than others do; password=hunter2222') as text", "lang", "source", "n_chars")
    work = docs.union(extra).union(twin).union(key)
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        work = stage(spark, work, SF_DIR)
        assert work.columns == columns
        seen[name] = {r.doc_id: r.text for r in work.collect()}
    assert -1 not in seen["language"]
    first = docs.orderBy("doc_id").first()
    assert first.doc_id in seen["quality"] and first.doc_id + 100000 in seen["quality"]
    assert first.doc_id in seen["near_duplicates"] and first.doc_id + 100000 not in seen["near_duplicates"]
    assert not any("hunter2222" in (t or "") for t in seen["secrets"].values())
    assert len(seen["secrets"]) == len(seen["near_duplicates"]) <= len(seen["quality"]) <= len(seen["language"])


def test_run_packs_what_is_left(spark):
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    docs = {r.doc_id for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} <= docs and len({r.doc_id for r in rows}) > 0.7 * len(docs)
    ends = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    at = 0
    for sequence, offset, length in ends:
        assert sequence * 4096 + offset == at
        at += length


def test_stages_without_rows(spark):
    work = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        work = stage(spark, work, SF_DIR)
    assert work.count() == 0
    assert (language.UNKNOWN, quality.THRESHOLD, near_dups.WORDS) == ("und", 0.7, 5)


def test_rows_of_one_id_become_one(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    some = docs.where("doc_id < 20")
    nameless = some.limit(1).selectExpr("cast(null as bigint) as doc_id", "text", "lang", "source", "n_chars")
    work = some.union(some.where("doc_id < 3")).union(nameless).union(nameless)
    alone = {r.doc_id for r in corpus_pipeline.one_of_each(spark, some, SF_DIR).collect()}
    got = [r.doc_id for r in corpus_pipeline.one_of_each(spark, work, SF_DIR).collect()]
    assert sorted(i for i in got if i is not None) == sorted(alone) and got.count(None) == 2


def test_near_duplicates_are_those_of_brute_force_at_80_percent(spark):
    draw = random.Random(4)
    rows = []
    for base in range(12):
        words = [f"w{base}x{draw.randrange(10**6)}" for _ in range(300)]
        other = list(words)
        # every word changed apart from the others costs five shingles of 296
        for at in draw.sample(range(10, 290, 8), 4 + base % 4):
            other[at] = "new"
        rows += [(2 * base, " ".join(words)), (2 * base + 1, " ".join(other))]
    sets = [shingles(t) for _, t in rows]
    shares = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert sum(0.8 <= s < 0.85 for s in shares) >= 3 and min(shares) < 0.8
    docs = spark.createDataFrame([(i, t, "en", "x", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, SF_DIR).collect())
    assert got == sorted(i for i, _, _, kept in expected(rows, 80) if kept)


def test_rows_with_one_id_and_other_texts_stay(spark):
    one, two = (" ".join(f"{letter}{i}" for i in range(100)) for letter in "ab")
    rows = [(7, one, "en", "x", 1), (7, two, "en", "x", 2), (7, one + " more", "en", "x", 3), (8, two + " end", "en", "x", 4), (8, "c d e", "en", "x", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id, r.text.split()[0]) for r in corpus_pipeline.one_of_each(spark, docs, SF_DIR).collect())
    assert got == [(7, "a0"), (7, "b0"), (8, "c")]


def test_columns_of_any_name_and_type_pass_all_stages(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    names = ("lang_pred", "lang_score", "quality_score", "_row", "row", "hash", "secrets", "_language", "component_id", "n_tokens")
    work = docs.select("*", *(F.lit(name).alias(name) for name in names), F.lit(1).alias("a.b"), F.lit(2).alias("tick`s"))
    work = work.withColumns({"map": F.create_map(F.lit("k"), F.col("doc_id")), "list": F.array(F.lit("x"))})
    work = work.union(work.limit(3)).union(work.limit(2).withColumn("text", F.lit(None).cast("string")))
    plain, columns = docs.union(docs.limit(3)).union(docs.limit(2).withColumn("text", F.lit(None).cast("string"))), work.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        work, plain = stage(spark, work, SF_DIR), stage(spark, plain, SF_DIR)
        assert work.columns == columns
        rows = work.collect()
        assert rows and all(r[c] == c for r in rows for c in names) and all(r["a.b"] == 1 and r["tick`s"] == 2 and r["map"] == {"k": r.doc_id} for r in rows)
        if name != "near_duplicates":
            assert sorted((r.doc_id, r.text or "", r.n_chars) for r in rows) == sorted((r.doc_id, r.text or "", r.n_chars) for r in plain.collect())
        work, plain = (spark.createDataFrame(x.collect(), x.schema) for x in (work, plain))
    assert corpus_pipeline.STAGES[-1][1](spark, work, SF_DIR).count() > 0
