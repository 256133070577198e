"""Many outputs of one job, committed together: written aside, listed, then moved into place.

A run may break off anywhere. Before the list is there, nothing has been moved and the outputs are written anew; once it
is there, ``resume`` moves what is left of it. So an output is either absent or whole, and none is written twice.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAGING = "_staging-"
LIST = "outputs.json"
MARKER = "_SUCCESS"


class _Files:
    """The file system of a folder; ``before`` is called with the name of each step that changes it."""

    def __init__(self, spark: SparkSession, root: str, before: Callable[[str], None]):
        self.paths = spark._jvm.org.apache.hadoop.fs
        self.system = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.before = before

    def path(self, name: str):
        return self.paths.Path(name)

    def exists(self, name: str) -> bool:
        return self.system.exists(self.path(name))

    def folders(self, pattern: str) -> list[str]:
        found = self.system.globStatus(self.path(pattern))
        return sorted(str(s.getPath().toString()) for s in found or () if s.isDirectory())

    def move(self, source: str, target: str) -> None:
        self.before(f"move {target}")
        self.system.mkdirs(self.path(target).getParent())
        if not self.system.rename(self.path(source), self.path(target)):
            raise OSError(f"could not move {source} to {target}")

    def write(self, name: str, text: str) -> None:
        """A small file, whole or not at all."""
        self.before(f"write {name}")
        out = self.system.create(self.path(f"{name}.part"), True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.system.rename(self.path(f"{name}.part"), self.path(name)):
            raise OSError(f"could not write {name}")

    def read(self, name: str) -> str:
        status = self.system.getFileStatus(self.path(name))
        data = self.system.open(self.path(name))
        try:
            return bytes(data.readNBytes(status.getLen())).decode()
        finally:
            data.close()

    def remove(self, name: str) -> None:
        self.before(f"remove {name}")
        self.system.delete(self.path(name), True)


def _finish(files: _Files, stage: str, root: str) -> list[str]:
    """Move the listed outputs that are still aside, mark each, and remove what is left of the stage."""
    done = []
    for name in json.loads(files.read(f"{stage}/{LIST}")):
        source, target = f"{stage}/data/{name}", f"{root}/{'/'.join(unquote(p.split('=', 1)[1]) for p in name.split('/'))}"
        if files.exists(source):
            if files.exists(target):
                raise FileExistsError(f"{target} is there already")
            files.move(source, target)
        if not files.exists(f"{target}/{MARKER}"):
            files.write(f"{target}/{MARKER}", "")
        done.append(target)
    files.remove(stage)
    return done


def resume(spark: SparkSession, root: str, before: Callable[[str], None] = lambda step: None) -> list[str]:
    """Finish the runs below ``root`` that broke off after their list was written, drop the others; returns the folders of outputs."""
    files = _Files(spark, root, before)
    done = []
    for stage in files.folders(f"{root}/{STAGING}*"):
        if files.exists(f"{stage}/{LIST}"):
            done += _finish(files, stage, root)
        else:
            files.remove(stage)
    return done


def write_outputs(
    df: DataFrame, root: str, keys: Sequence[str], leave_out: Sequence[str] = (), before: Callable[[str], None] = lambda step: None
) -> list[str]:
    """Write ``df`` as Parquet with a folder ``root/<key>/<key>...`` for each combination of ``keys``, in one job; returns the folders.

    The columns of ``leave_out`` are not written, all others are, keys too. Every folder has a marker when it is whole. A folder that is there already is an
    error, found before anything is moved. Null keys are not allowed. ``before`` is called before every step that
    changes the folders, with its name.
    """
    spark = df.sparkSession
    files = _Files(spark, root, before)
    stage = f"{root}/{STAGING}{uuid.uuid4().hex}"
    before(f"stage {stage}")
    names = [f"_output{i}" for i in range(len(keys))]
    if not df.where(" or ".join(f"`{k}` is null" for k in keys)).isEmpty():
        raise ValueError(f"a key of {', '.join(keys)} is null")
    parts = df.withColumns({n: F.col(f"`{k}`").cast("string") for n, k in zip(names, keys, strict=True)})
    parts.drop(*leave_out).write.option("compression", "zstd").partitionBy(*names).parquet(f"{stage}/data")
    found = files.folders(f"{stage}/data/{'/'.join(['*=*'] * len(keys))}")
    outputs = ["/".join(folder.rsplit("/", len(keys))[1:]) for folder in found]
    taken = [o for o in outputs if files.exists(f"{root}/{'/'.join(unquote(p.split('=', 1)[1]) for p in o.split('/'))}")]
    if taken:
        files.remove(stage)
        raise FileExistsError(f"outputs are there already: {taken}")
    files.write(f"{stage}/{LIST}", json.dumps(outputs))
    return _finish(files, stage, root)
