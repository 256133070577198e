"""Line numbers over splits, and heads of files."""

import io

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from curate.sources.heads import head_batches, read_heads
from curate.sources.labelled import read_labelled_jsonl, read_labelled_lines
from curate.sources.lines import read_numbered_lines


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def lines_of(n, seed):
    draw = np.random.default_rng(seed)
    return ["" if draw.random() < 0.2 else "é" * int(draw.integers(0, 90)) + f" {i}" for i in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_lines_are_numbered_over_splits(spark, tmp_path, small_splits, end):
    want = []
    for name, n in (("a.txt", 300), ("b.txt", 1), ("c.txt", 41), ("empty.txt", 0)):
        lines = lines_of(n, n)
        (tmp_path / name).write_bytes(end.join([*lines, ""]).encode())
        want += [(name, i + 1, line) for i, line in enumerate(lines)]
    found = read_numbered_lines(spark, f"file://{tmp_path}")
    assert found.rdd.getNumPartitions() > 20
    assert sorted((r.file.rsplit("/", 1)[1], r.line_number, r.value) for r in found.collect()) == sorted(want)


def test_rejects_name_their_file_and_line(spark, tmp_path, small_splits):
    lines = ['{"label": "positive", "text": "x"}', "", '{"label": "pos', "  ", "[1]"] * 40
    (tmp_path / "s.jsonl").write_text("\n".join(lines))
    found = read_labelled_jsonl(spark, f"file://{tmp_path}/s.jsonl")
    assert found.rows.count() == 40
    want = sorted(i + 1 for i, line in enumerate(lines) if line.startswith('{"label": "pos') and not line.endswith("}"))
    got = {r.line_number for r in found.rejects.collect()}
    assert set(want) <= got and all(lines[n - 1].strip() for n in got)
    (tmp_path / "t.txt").write_text("__label__positive a\nno label\r\n__label__odd b\n\n__label__negative\n")
    rejects = read_labelled_lines(spark, f"file://{tmp_path}/t.txt").rejects
    assert sorted((r.line_number, r.reason) for r in rejects.collect()) == [(2, "no label"), (3, "unknown label"), (4, "no label"), (5, "no text")]
    nothing = read_labelled_jsonl(spark, f"file://{tmp_path}/none").rejects
    assert nothing.columns == ["line", "reason", "file", "line_number"] and nothing.count() == 0


class Counted(io.RawIOBase):
    """A file that counts the bytes it gives."""

    def __init__(self, data):
        self.inner, self.given = io.BytesIO(data), 0

    def read(self, n=-1):
        out = self.inner.read(n)
        self.given += len(out)
        return out

    def seek(self, at, how=0):
        return self.inner.seek(at, how)

    def tell(self):
        return self.inner.tell()

    def readable(self):
        return True

    def seekable(self):
        return True


def test_bytes_read_do_not_grow_with_the_file():
    given = []
    for rows in (5_000, 100_000):
        draw = np.random.default_rng(1)
        vectors = pa.FixedSizeListArray.from_arrays(pa.array(draw.random(rows * 8)), 8).cast(pa.list_(pa.float64()))
        out = io.BytesIO()
        # one row group of any size
        pq.write_table(pa.table({"id": pa.array(range(rows)), "text": ["x" * 50] * rows, "v": vectors}), out, row_group_size=rows, data_page_size=1 << 14, use_dictionary=["text"])
        file = Counted(out.getvalue())
        found = pa.Table.from_batches(head_batches(pa.PythonFile(file), 100, ["id", "v"]))
        assert found.column("id").to_pylist() == list(range(100))
        given.append(file.given)
        assert len(out.getvalue()) > 10 * given[-1] or rows == 5_000
    assert given[1] < 1.5 * given[0]


def test_heads_of_files_of_all_sizes(spark, tmp_path):
    for i, n in enumerate((500, 7, 0, 3000)):
        rows = [(i * 10_000 + k, [float(k)], {"a": "b"} if k % 2 else None) for k in range(n)]
        pq.write_table(pa.table({"id": [r[0] for r in rows], "v": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "t": [f"é{r[0]}" for r in rows]}), tmp_path / f"f{i}.parquet", row_group_size=64)
    got = read_heads(spark, f"file://{tmp_path}", 400, ["v", "id"])
    assert got.columns == ["v", "id"]
    want = [*range(100), *range(10_000, 10_007), *range(30_000, 30_100)]
    assert sorted(r.id for r in got.collect()) == want
    assert read_heads(spark, f"file://{tmp_path}", 1).count() == 3
    assert got.where(F.col("v")[0] > 90).count() == 18
