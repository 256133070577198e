import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from curate.functions.vectors import masked_mean
from curate.operators.embedding import HashedWords, chunks, embed, mean_pool
from curate.operators.rehydrate import WEIGHTS, upsampling_weight
from curate.operators.tokens import batch_tokenizer, read_shards, shard_by_tokens, tokenize, write_shards
from curate.sources.documents import choose_files
from curate.sources.sinks import finished, unfinished, write_documents
from curate.operators.rehydrate import rehydrate
from curate.session import scratch_path


def test_weights(spark):
    import bisect

    sizes = [-7, 0, 1, 2, 3, 4, 5, 6, 99, 100, 999, 1000, 10**6]
    steps = sorted(WEIGHTS)
    want = [WEIGHTS[steps[bisect.bisect_right(steps, s) - 1]] for s in sizes]
    df = spark.createDataFrame(list(enumerate(sizes)), "n int, size long")
    assert [r[0] for r in df.orderBy("n").select(upsampling_weight(F.col("size"))).collect()] == want


def test_windows_cover_every_token(spark):
    docs = spark.createDataFrame([(n, [str(i) for i in range(n)]) for n in range(9)] + [(9, None)], "id int, t array<string>")
    for row in docs.select("id", "t", chunks(F.col("t"), 3).alias("c")).collect():
        tokens = row["t"] or []
        assert row["c"] == ([tokens[i : i + 3] for i in range(0, len(tokens), 3)] or [[]])


def test_embedding_does_not_depend_on_batches(spark):
    docs = spark.createDataFrame(
        [(n, [f"w{i % 11}" for i in range(n)]) for n in range(40)] + [(99, None)], "id int, t array<string>"
    )

    def vectors(parts, batch):
        column = embed(F.col("t"), lambda: HashedWords(4), 7, batch).alias("v")
        return {r["id"]: r["v"] for r in docs.repartition(parts).select("id", column).collect()}

    got = vectors(1, 1000)
    assert got == vectors(7, 3)
    for n in range(40):
        assert len(got[n]) == max(1, -(-n // 7))
        assert got[n][0] == pytest.approx(HashedWords(4)(pa.array([[f"w{i % 11}" for i in range(min(n, 7))]], pa.list_(pa.string())))[0].tolist())
    assert got[99] == [[0.0] * 4]


def test_masked_mean(spark):
    rows = [(1, [[1.0, 2.0], [3.0, 4.0]], [1, 1]), (2, [[1.0, 2.0], [3.0, 4.0]], [0, 1]), (3, [[1.0, 2.0]], [0])]
    df = spark.createDataFrame(rows, "n int, v array<array<double>>, m array<int>")
    got = [r[0] for r in df.orderBy("n").select(masked_mean(F.col("v"), F.col("m"), 2)).collect()]
    assert got == [[2.0, 3.0], [3.0, 4.0], [0.0, 0.0]]
    assert mean_pool(np.array([[[1.0, 2.0], [3.0, 4.0]]]), np.array([[0, 1]])).tolist() == [[3.0, 4.0]]


@pytest.mark.parametrize("partitions", [1, 6])
def test_shards_follow_the_running_sum(spark, partitions):
    rng = np.random.default_rng(4)
    lengths = rng.integers(0, 30, size=500).tolist()
    docs = [(i, " ".join(["w"] * n)) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(docs, "id long, text string").repartition(partitions)
    tokens = tokenize(df, "id", cluster_size=F.col("id") % 5)
    got = {(r["id"], r["copy_no"]): r["shard"] for r in shard_by_tokens(tokens, "id", 64).collect()}
    seen = 0
    for i, n in enumerate(lengths):
        for copy in range(1, [1, 1, 2, 3, 3][i % 5] + 1):
            assert got.pop((i, copy)) == seen // 64
            seen += n
    assert not got


def test_file_choice(spark):
    files = [f"/x/{i}.parquet" for i in range(5)]
    assert choose_files(spark, files, None) == files
    assert len(set(choose_files(spark, files, 3))) == 3
    with pytest.raises(ValueError):
        choose_files(spark, files, 6)


def test_finished_outputs_are_skipped(spark):
    root = scratch_path(spark, "out")
    write_documents(spark.range(3), f"{root}/fr")
    wanted = spark.createDataFrame([("fr",), ("de",)], "lang string")
    assert [r["lang"] for r in unfinished(wanted, finished(spark, root, ["fr", "de"])).collect()] == ["de"]
    with pytest.raises(Exception):
        write_documents(spark.range(3), f"{root}/fr")


def test_library_tokenizer_and_written_shards(spark):
    docs = spark.createDataFrame([(i, "x " * i) for i in range(20)] + [(20, None)], "id long, text string")
    encode = batch_tokenizer(lambda: lambda texts: [[len(w) for w in t.split()] for t in texts])
    tokens = tokenize(docs, "id", tokenizer=encode).cache()
    assert {r["id"]: r["n_tokens"] for r in tokens.collect()} == {**{i: i for i in range(20)}, 20: 0}
    path = scratch_path(spark, "shards")
    write_shards(shard_by_tokens(tokens, "id", 50), path, "id")
    written = spark.read.parquet(path)
    assert written.count() == 21
    assert written.agg(F.max("shard")).first()[0] == 190 // 50
    # files in order of their names hold the rows of a shard in order of the key
    rows = written.select("shard", "id", "_metadata.file_name", "_metadata.row_index").collect()
    placed = [(r["shard"], r["id"]) for r in sorted(rows, key=lambda r: (r["shard"], r["file_name"], r["row_index"]))]
    assert placed == sorted(placed)


def test_words_are_hashed_as_the_session_would(spark, monkeypatch):
    from curate.functions.text import WHITESPACE_CHARACTERS, words
    from curate.operators import tokens as T

    odd = [f"a{c}b" for c in [*WHITESPACE_CHARACTERS, "\u200b", "\u180e", "\x00", "\ufeff", "\u2060"]]
    texts = [None, "", "  ", *odd, WHITESPACE_CHARACTERS.join("xyx"), " the the  end ", "\U0001f600 \u00e9", None, "z" * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(1).sortWithinPartitions("id")
    docs = docs.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.expr("cast(X'6120ff62' as string)").alias("text")))
    hashed = F.transform(words(F.col("text")), lambda w: F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("int") % 1000)
    want = {r["id"]: r["t"] for r in docs.select("id", hashed.alias("t")).collect()}
    for size in (1, 10, 4_000_000):
        found = T.pa.concat_arrays([T._word_ids(texts[i : i + size], 1000) for i in range(0, len(texts), size)])
        assert dict(enumerate(found.to_pylist())) == {k: v for k, v in want.items() if k >= 0}
    got = {r["id"]: r["t"] for r in docs.select("id", T.hashed_word_ids(F.col("text"), 1000).alias("t")).collect()}
    assert got == want


def shard_rows(n, shards):
    return [(i // -(-n // shards), f"k{i:04d}", 1, None if i % 7 == 0 else [i, None, -i], i % 7, i / 3, b"\0" * (i % 3)) for i in range(n)]


PLAIN_SHARDS = "shard long, id string, copy_no int, tokens array<int>, n_tokens int, weight double, raw binary"


def test_many_small_shards_need_no_process_per_folder(spark, tmp_path):
    rows = shard_rows(600, 150) + [(None, "last", 1, [], 0, None, None), (0, None, 1, [5], 1, 0.5, b"x")]
    df = spark.createDataFrame(rows, PLAIN_SHARDS)
    ours, plain = f"file://{tmp_path}/new/shards", f"file://{tmp_path}/plain"
    write_shards(df, ours, "id")
    df.write.partitionBy("shard").parquet(plain)
    # Hadoop's writer leaves a checksum beside every file
    files = [f for f in (tmp_path / "new").rglob("*") if f.is_file()]
    assert len(files) >= 152 and not [f for f in files if f.suffix == ".crc" or f.name.startswith(".")]
    assert [f.name for f in (tmp_path / "new").iterdir()] == ["shards"]
    got, want = spark.read.parquet(ours), spark.read.parquet(plain)
    assert got.schema == want.schema
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_folders_of_shards_are_listed_by_few_tasks(spark, tmp_path):
    path, tracker = f"file://{tmp_path}/shards", spark.sparkContext.statusTracker()
    write_shards(spark.createDataFrame(shard_rows(300, 150), PLAIN_SHARDS), path, "id")
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        assert read_shards(spark, path).count() == 300
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(stage.numTasks for stage in stages if stage) <= 4 * spark.sparkContext.defaultParallelism


def test_long_shards_are_written_in_row_groups(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq
    from curate.operators import tokens as T

    monkeypatch.setattr(T, "ROW_GROUP_BYTES", 100)
    batch = pa.RecordBatch.from_pydict({"id": list(range(100))})
    assert T._write_file(str(tmp_path / "x.parquet"), iter([batch.slice(i, 10) for i in range(0, 100, 10)])) == 100
    found = pq.ParquetFile(tmp_path / "x.parquet")
    assert found.num_row_groups == 5 and found.read()["id"].to_pylist() == list(range(100))


def test_shards_of_other_types_are_written_by_spark(spark, tmp_path):
    rows = spark.createDataFrame(shard_rows(60, 20), PLAIN_SHARDS).withColumn("id", F.timestamp_seconds(F.substring("id", 2, 4).cast("int")))
    path = f"file://{tmp_path}/shards"
    write_shards(rows, path, "id")
    got = spark.read.parquet(path).select(rows.columns)
    assert dict(got.dtypes)["id"] == "timestamp"
    assert sorted(map(repr, got.collect())) == sorted(map(repr, rows.collect()))


def test_shards_are_whole_or_absent(spark, tmp_path):
    df = spark.createDataFrame(shard_rows(40, 10), PLAIN_SHARDS)
    path = f"file://{tmp_path}/shards"
    with pytest.raises(Exception):
        write_shards(df.withColumn("n_tokens", F.raise_error(F.lit("broken")).cast("int")), path, "id")
    assert not list(tmp_path.iterdir())
    write_shards(df, path, "id")
    with pytest.raises(Exception):
        write_shards(df, path, "id")
    assert spark.read.parquet(path).count() == 40


def test_a_document_without_a_size_stays(spark):
    docs = spark.createDataFrame([(1, 3), (2, None), (3, 1)], "id int, size int")
    got = sorted((r["id"], r["copy_no"]) for r in rehydrate(docs, F.col("size")).collect())
    assert got == [(1, 1), (1, 2), (1, 3), (2, 1), (3, 1)]


def plain_vectors(lists, begin, end):
    from catalog.encoder_file import weights

    return np.array([weights()[[*begin, *ids, *end]].astype(float).mean(axis=0) if [*begin, *ids, *end] else np.zeros(4) for ids in lists])


def test_an_encoder_file_in_batches_by_length(tmp_path):
    import pyarrow as pa

    from catalog.encoder_file import encoder_bytes
    from curate.models.encoder import OnnxEncoder

    path = tmp_path / "tiny.onnx"
    path.write_bytes(encoder_bytes())
    draw = np.random.default_rng(3)
    lists = [draw.integers(0, 64, n).tolist() for n in (*draw.integers(0, 60, 200), 500, 500, 0)]
    windows = pa.array([None, *lists], pa.list_(pa.int64())).slice(1)
    for begin, end in (((1,), (2,)), ((), ())):
        encoder = OnnxEncoder(str(path), begin, end, budget=600)
        assert np.allclose(encoder(windows), plain_vectors(lists, begin, end), atol=1e-6)
        # no call is larger than the budget, and little of it is padding
        assert max(rows * width for rows, width in encoder.calls) <= 600
        used = sum(len(x) + len(begin) + len(end) for x in lists)
        assert sum(rows * width for rows, width in encoder.calls) < 1.2 * used + 64
    assert OnnxEncoder(str(path))(windows.slice(0, 0)).shape == (0, 1)


def test_one_very_long_document_stays_within_the_budget(spark, tmp_path):
    import pyarrow as pa

    from catalog.encoder_file import encoder_bytes
    from curate.models.encoder import OnnxEncoder, ship
    from curate.operators.embedding import _windows

    path = tmp_path / "shipped.onnx"
    path.write_bytes(encoder_bytes())
    long = [i % 64 for i in range(300_000)]
    docs = spark.createDataFrame([(1, long), (2, [5]), (3, []), (4, None)], "id long, ids array<long>")
    got = {r["id"]: r["v"] for r in docs.select("id", embed(F.col("ids"), ship(spark, f"file://{path}", begin=[1], end=[2], budget=4096), 510).alias("v")).collect()}
    assert [len(got[i]) for i in (1, 2, 3, 4)] == [589, 1, 1, 1]
    cuts = [long[at : at + 510] for at in range(0, len(long), 510)]
    assert np.allclose(got[1], plain_vectors(cuts, [1], [2]), atol=1e-6) and np.allclose(got[4], plain_vectors([[]], [1], [2]), atol=1e-6)
    encoder = OnnxEncoder(str(path), [1], [2], budget=4096)
    windows, _ = _windows(pa.array([long], pa.list_(pa.int64())), 510)
    encoder(windows)
    assert max(rows * width for rows, width in encoder.calls) <= 4096
