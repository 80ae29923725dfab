"""Intermediate tables in the folder that the cluster shares: they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_OWN_DIRS: dict[str, str] = {}
_CLEARED: set[str] = set()
#: Where the written frames lie, by their identity.
_PATHS: dict[int, tuple[weakref.ref, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The application's own folder under spark.checkpoint.dir; a temporary one only where that is unset on one machine."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _OWN_DIRS.setdefault(context.applicationId, tempfile.mkdtemp(prefix="spark-roadloom-"))
    path = f"{base.rstrip('/')}/roadloom/{context.applicationId}"
    if path not in _CLEARED:
        _CLEARED.add(path)
        atexit.register(_clear, spark, path)
    return path


def _clear(spark: SparkSession, path: str) -> None:
    """The application's tables go when its driver ends in good order."""
    try:
        jvm = spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(place, True)
    except Exception:  # noqa: BLE001 (the gateway may be gone already)
        pass


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (weakref.ref(out), path)
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of `materialize` that no frame in use reads any more; other frames are left alone."""
    ref, path = _PATHS.pop(id(df), (None, ""))
    if ref is not None and ref() is df:
        _clear(df.sparkSession, path)
