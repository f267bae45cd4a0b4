"""What the operators share: written tables in the cluster's shared folder, and word splitting."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOTS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir.

    The setting is read from the session. In local mode without it a temporary folder takes its
    place; a cluster must set it. The folder goes when the application ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="quernstone-")
        _ROOTS[app] = f"{base.rstrip('/')}/quernstone-{app}"
        atexit.register(_remove, spark, _ROOTS[app])
    return _ROOTS[app]


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None or sc._jvm is None:
        return
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    try:
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone by now; the folder is then the cluster's to clear
        pass


class Table:
    """A table written to the shared folder: lineage ends here, and lost executors don't matter."""

    def __init__(self, df: DataFrame, name: str, codec: str = "zstd", most_rows: int = 0):
        """most_rows: of a file, for tables of large rows; 0 sets no bound."""
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.option("compression", codec).option("maxRecordsPerFile", most_rows).parquet(self.path)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def drop(self) -> None:
        _remove(self.spark, self.path)


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    return Table(df, name, codec).df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a text with A-Z in lower case, as UTF-8. None has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly when the input's files are fewer than the cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.rdd.getNumPartitions()
    return df if parts >= cores else df.repartition(cores)


def dealt(df: DataFrame, *by: str) -> DataFrame:
    """df dealt by columns into four parts for each core; a given number isn't coalesced by bytes.

    For few bytes that take long, such as keys to be made in Python.
    """
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *by)


def crc_mod(column: str, by: int):
    """crc32 of an id written as text, modulo by."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(by)


#: A side of a join is broadcast only if a count of its rows proves it this small.
BROADCAST_BYTES = 16 << 20


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df marked for broadcast if its counted rows are within the bound, else as it is.

    For tables that have been written: counting reads footers only.
    """
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df
