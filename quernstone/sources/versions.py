"""Tables that are replaced as a whole: each writing is a new version, and readers open the newest.

A version is written under another name and renamed when complete, which is one step of the file
system. Nothing is deleted before: until the rename readers see the version before, which stays
for those who opened it; older ones go.
"""

from __future__ import annotations

import atexit
import tempfile
import time
import uuid
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_SCRATCH: dict[str, str] = {}


def fs_of(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def names(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(name, is folder) of what a folder holds; none if there is no such folder."""
    fs, at = fs_of(spark, path)
    return [(s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(at)] if fs.exists(at) else []


def _numbers(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n[2:]) for n, folder in names(spark, path) if folder and n.startswith("v-") and n[2:].isdigit())


def latest(spark: SparkSession, path: str) -> str | None:
    """Path of the newest complete version, None without one."""
    found = _numbers(spark, path)
    return f"{path}/v-{found[-1]}" if found else None


def staging(path: str) -> str:
    return f"{path}/building-{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"


def publish(spark: SparkSession, made: str, path: str) -> str:
    """Makes what was written at made the newest version of path; the newest but one stays."""
    fs, at = fs_of(spark, made)
    target = lambda n: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/v-{n}")
    while True:
        found = _numbers(spark, path)
        number = found[-1] + 1 if found else 0
        # a writer that was quicker has taken the number: the next one, then
        if not fs.exists(target(number)) and fs.rename(at, target(number)):
            break
    for old in found[:-1]:
        fs.delete(target(old), True)
    return f"{path}/v-{number}"


def scratch(spark: SparkSession) -> str:
    """This application's folder for tables of a query, below spark.checkpoint.dir; it goes at the end."""
    app = spark.sparkContext.applicationId
    if app not in _SCRATCH:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="quernstone-")
        _SCRATCH[app] = f"{base.rstrip('/')}/scratch-{app}"
        atexit.register(_gone, spark, _SCRATCH[app])
    return f"{_SCRATCH[app]}/{uuid.uuid4().hex}"


def write_texts(rows: DataFrame, home: str) -> None:
    """Each (name, text) as a file of its own below home, in whose folders they go; a file ends in a new line.

    Texts of one name follow one another in its file. The tasks write the files themselves: Spark's
    writer would name them, so that the driver had to rename each. It does where only Spark knows the store.
    """
    from pyarrow.fs import FileSystem

    name, text = rows.columns
    try:
        FileSystem.from_uri(home)
    except (pa.ArrowException, OSError):
        _renamed_texts(rows.select(name, text), home)
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = FileSystem.from_uri(home)
        parts = ((name.as_py(), text.as_py()) for b in batches for name, text in zip(b.column(0), b.column(1), strict=True))
        for name, group in groupby(parts, itemgetter(0)):
            made = f"{base}/{name}.{uuid.uuid4().hex}"
            with fs.open_output_stream(made) as out:
                for _, text in group:
                    out.write(text.encode() + b"\n")
            # complete under its name, whatever becomes of another attempt of the task
            fs.move(made, f"{base}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())], ["n"])

    rows.repartition(name).sortWithinPartitions(name, text).mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


def _renamed_texts(rows: DataFrame, home: str) -> None:
    spark, raw = rows.sparkSession, f"{home}/raw-{uuid.uuid4().hex}"
    name, text = rows.columns
    rows.repartition(name).write.partitionBy(name).text(raw)
    fs, old = fs_of(spark, raw)
    for folder, is_folder in names(spark, raw):
        if is_folder:
            part = next(n for n, _ in names(spark, f"{raw}/{folder}") if n.startswith("part-"))
            fs.rename(fs_of(spark, f"{raw}/{folder}/{part}")[1], fs_of(spark, f"{home}/{unquote(folder.partition('=')[2])}")[1])
    fs.delete(old, True)


def _gone(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None or sc._jvm is None:
        return
    try:
        fs, at = fs_of(spark, path)
        fs.delete(at, True)
    except Exception:  # the JVM may be gone by now; the folder is then the cluster's to clear
        pass
