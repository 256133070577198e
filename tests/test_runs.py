"""Runs that break off and go on: staged outputs and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curate.operators.scoring import MlpScorer
from curate.plans.select import select_top
from curate.sources.staged import resume, write_outputs
from curate.streaming.select import read_split, stream_split


class Broken(Exception):
    pass


class Fuse:
    """Breaks at one of the steps, from 0."""

    def __init__(self, at):
        self.left = at

    def __call__(self, step):
        if self.left == 0:
            raise Broken(step)
        self.left -= 1


def contents(spark, root, folders):
    return {
        name: sorted(tuple(r) for r in spark.read.parquet(f"{root}/{name}").collect()) for name in folders if (root_path(root) / name / "_SUCCESS").exists()
    }


def root_path(root):
    from pathlib import Path

    return Path(root.removeprefix("file://"))


def test_a_run_that_breaks_anywhere_goes_on_without_double_or_partial_outputs(spark, tmp_path):
    rows = [("de", "train", 1), ("de", "test", 2), ("fr", "train", 3), ("a b/ü", "test", 4), ("fr", "train", 5)]
    df = spark.createDataFrame(rows, "lang string, part string, n int").coalesce(2)
    folders = ["de/train", "de/test", "fr/train", "a b/ü/test"]
    want = {f"{lang}/{part}": sorted((g, p, n) for g, p, n in rows if (g, p) == (lang, part)) for lang, part, _ in rows}
    broke = 0
    for at in range(100):
        root = f"file://{tmp_path}/run-{at}"
        fuse = Fuse(at)
        try:
            done = write_outputs(df, root, ["lang", "part"], before=fuse)
        except Broken:
            broke += 1
            before = contents(spark, root, folders)
            assert all(before[name] == want[name] for name in before)
            # the run that goes on breaks as well, one step later
            try:
                resume(spark, root, before=Fuse(1))
            except Broken:
                pass
            resume(spark, root)
            if not contents(spark, root, folders):
                write_outputs(df, root, ["lang", "part"])
            done = [f"{root}/{name}" for name in folders]
        assert contents(spark, root, folders) == want and len(done) == 4
        assert not list(root_path(root).glob("_staging-*"))
        if fuse.left > 0:
            break
    # aside, the list, and a move and a marker for each of four outputs, and the removal
    assert broke == 11
    with pytest.raises(FileExistsError):
        write_outputs(df, root, ["lang", "part"])
    assert contents(spark, root, folders) == want and not list(root_path(root).glob("_staging-*"))
    with pytest.raises(ValueError):
        write_outputs(df.withColumn("lang", F.lit(None).cast("string")), f"file://{tmp_path}/null", ["lang"])


def test_a_restarted_stream_gives_the_rows_of_the_batch(spark, tmp_path):
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=3).tolist()) for i in range(90)] + [(90, None)]
    docs = spark.createDataFrame(rows, "id long, embedding array<double>")
    model = MlpScorer(draw.normal(size=(4, 3)), draw.normal(size=4), draw.normal(size=4), 0.0)
    selection = select_top(docs, model, retention=0.3)
    threshold = selection.threshold.first()["threshold"]
    docs.repartition(6).write.parquet(f"file://{tmp_path}/in")
    arriving = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    out, log, written = f"file://{tmp_path}/out", f"file://{tmp_path}/log", []

    def stop(batch):
        written.append(batch)
        if len(written) in (1, 4):
            raise Broken(batch)

    for broken in (True, True, False):
        if broken:
            with pytest.raises(Exception):
                stream_split(arriving, model, threshold, out, log, after=stop)
        else:
            stream_split(arriving, model, threshold, out, log, after=stop)
    # two batches came again under their numbers
    assert len(written) == 8 and sorted(set(written)) == list(range(6))
    kept, rejected = read_split(spark, out, docs.schema)
    key = lambda rows: sorted((r["id"], r["quality_score"]) for r in rows.select("id", "quality_score").collect())
    assert key(kept) == key(selection.kept)
    assert key(rejected) == key(selection.rejected)
