"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
MAX_SPREAD = 128


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``.

    Where the setting is missing, a local session gets a fresh temporary folder; a cluster
    session is refused, because a machine-local folder would be lost with its machine.
    """
    configured = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder that every executor can reach")
    fresh = tempfile.mkdtemp(prefix="occugrid-")
    spark.conf.set(_SETTING, fresh)
    return fresh


# Paths handed out inside each running job, the innermost job last.
_SCOPES: list[list[str]] = []


def new_table_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/occugrid/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def drops_its_tables(job: Callable) -> Callable:
    """A job ``(spark, ...)`` whose intermediate tables go when it ends, well or not.

    What it returns must not read them: paths of its results, not frames.
    """

    @functools.wraps(job)
    def run(spark: SparkSession, *args, **options):
        _SCOPES.append([])
        try:
            return job(spark, *args, **options)
        finally:
            jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
            for name in _SCOPES.pop():
                path = jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(conf).delete(path, True)

    return run


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table under ``path`` was written to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def written_table(df: DataFrame, name: str, spread_by: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back: lineage is cut, and a lost executor costs nothing.

    ``spread_by`` hash-partitions a small table before it is written, so that the many passes
    over it run in parallel; the number of files stays bounded on a large cluster.
    """
    spark = df.sparkSession
    path = new_table_path(spark, name)
    schema = df.schema
    if spread_by:
        df = df.repartition(min(spark.sparkContext.defaultParallelism, MAX_SPREAD), spread_by)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
