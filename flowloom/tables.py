"""Tables that several stages read again, kept where every executor sees them.

The folder is the one the session names in ``spark.checkpoint.dir``. Only when that is
unset in a local session, as in tests, a temporary folder is made and set; a cluster has to name one. Files are written
and read by Spark alone, so losing an executor loses nothing. What a process has kept is deleted
when it ends, or earlier by :func:`forget`.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: The setting that names the shared folder.
SETTING = "spark.checkpoint.dir"
#: Paths of this process, each with its file system and its path there.
_OWN: dict[str, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    there = spark.sparkContext.getConf().get(SETTING) or spark.conf.get(SETTING, None)
    if not there:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"{SETTING} must name a folder that the driver and all executors share")
        there = f"file://{tempfile.mkdtemp(prefix='flowloom-')}"
        spark.conf.set(SETTING, there)
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _OWN[path] = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target
    return path


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and return the table read from there."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._scratch_path = path
    return kept


class Rounds:
    """A table that grows by rounds: a folder each, all read as one scan however many there are."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.path, self.n, self.schema = new_path(spark, label), 0, None

    def add(self, df: DataFrame) -> DataFrame:
        """Write the rows of a round and return the table of them alone."""
        path = f"{self.path}/{self.n:06d}"
        df.write.parquet(path)
        self.n, self.schema = self.n + 1, self.schema or df.schema
        return df.sparkSession.read.schema(self.schema).parquet(path)

    def all(self, spark: SparkSession) -> DataFrame:
        """The rows of all rounds so far."""
        return spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)


def forget(df: DataFrame) -> None:
    """Delete what :func:`keep` wrote for ``df``, once nothing reads it any more."""
    system, target = _OWN.pop(getattr(df, "_scratch_path", ""), (None, None))
    if system is not None:
        system.delete(target, True)


@atexit.register
def _forget_all() -> None:
    for system, target in _OWN.values():
        with contextlib.suppress(Exception):  # the session may be gone, and its files with it
            system.delete(target, True)


#: Most bytes of a table that is broadcast.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, rows: int = 100_000, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows and about ``most`` bytes, else ``df`` as it is.

    ``df`` should be cheap to count, such as a table from :func:`keep`. Texts and arrays are measured, each as the text that
    shows it; other columns count as 8 bytes, and a row as 16 more.
    """
    wide = [f"`{f.name}`" for f in df.schema.fields if f.dataType.simpleString().startswith(("string", "binary", "array", "struct", "map"))]
    size = F.lit(16 + 8 * len(df.columns)).cast("long")
    for c in wide:
        size = size + F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    n, held = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and held <= most else df
