"""Tables written once to storage that every executor shares.

Intermediate tables are Parquet below ``spark.checkpoint.dir``, so a lost executor costs
a re-read, not a re-run of everything upstream, and plans that read a result several
times stay small.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_local_dirs: "weakref.WeakKeyDictionary[object, str]" = weakref.WeakKeyDictionary()
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.  Only a local session may do without: it gets a temporary one."""
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc not in _local_dirs:
        _local_dirs[sc] = tempfile.mkdtemp(prefix="spanforge-")
    return _local_dirs[sc]


def folder(spark: SparkSession, name: str) -> str:
    """The address of a new folder in shared storage, for files that tasks write; ``release`` deletes it like a table."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to shared storage and return the table read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """How many tables are there, for ``release``."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables written after ``since`` (a ``mark``), but for the last ``keep`` of them.

    Results that still read a deleted table end with it, so write them first.
    """
    gone = _written[since : len(_written) - keep]
    del _written[since : len(_written) - keep]
    for name in gone:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
