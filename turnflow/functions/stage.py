"""Written tables between steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is named, a temporary one, but on a local master only:
    executors on other machines couldn't read it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not getattr(spark, "_turnflow_shared", None):
        spark._turnflow_shared = tempfile.mkdtemp(prefix="turnflow-")
        atexit.register(shutil.rmtree, spark._turnflow_shared, ignore_errors=True)
    return spark._turnflow_shared


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: later steps survive a lost executor
    and don't compute it again. The table stays until its `stage_scope` ends, or `clear_stored`, as frames made of it read it lazily."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/turnflow/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark._turnflow_stored = [*getattr(spark, "_turnflow_stored", []), path]
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables stored within it, and no others of the session."""
    before = set(getattr(spark, "_turnflow_stored", []))
    try:
        yield
    finally:
        paths = getattr(spark, "_turnflow_stored", [])
        _delete(spark, [p for p in paths if p not in before])
        spark._turnflow_stored = [p for p in paths if p in before]


def clear_stored(spark: SparkSession) -> int:
    """Deletes the tables that this session has stored; call it when no frame made of them is needed any more."""
    paths = getattr(spark, "_turnflow_stored", [])
    _delete(spark, paths)
    spark._turnflow_stored = []
    return len(paths)
