"""Keyed tables of which a change set rewrites the touched buckets only; a manifest of buckets is the version."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the versions that were published whole, oldest first."""
    system, place = _files(spark, f"{path}/manifests")
    return sorted(s.getPath().getName() for s in system.listStatus(place)) if system.exists(place) else []


def manifest_of(spark: SparkSession, path: str, version: str | None = None) -> dict:
    """schema, key, buckets and the folder of each bucket that has rows."""
    name = version or versions(spark, path)[-1]
    return json.loads(spark.read.text(f"{path}/manifests/{name}", wholetext=True).first()[0])


def _publish(spark: SparkSession, path: str, manifest: dict) -> str:
    """The manifest's file is made under another name and then renamed, which is one step, so a reader sees all of it or none."""
    name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    system, draft = _files(spark, f"{path}/drafts/{name}")
    out = system.create(draft, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    _, final = _files(spark, f"{path}/manifests/{name}")
    system.mkdirs(final.getParent())
    if not system.rename(draft, final):
        raise OSError(f"{name} was not published")
    return name


def _bucket(key: list[str], buckets: int):
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _write(rows: DataFrame, key: list[str], buckets: int, path: str) -> tuple[str, set[int]]:
    """A new folder with a subfolder for each bucket that has rows."""
    folder = f"data/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    placed = rows.withColumn("bucket__", _bucket(key, buckets))
    placed.repartition("bucket__").write.partitionBy("bucket__").parquet(f"{path}/{folder}")
    system, place = _files(rows.sparkSession, f"{path}/{folder}")
    names = [s.getPath().getName() for s in system.listStatus(place)]
    return folder, {int(n.split("=")[1]) for n in names if n.startswith("bucket__=")}


def create(df: DataFrame, path: str, key: list[str], buckets: int = 64) -> str:
    """The first version of a table; a bucket should hold some hundred MB."""
    folder, filled = _write(df, key, buckets, path)
    return _publish(df.sparkSession, path, {"schema": df.schema.json(), "key": key, "buckets": buckets, "folders": {str(b): f"{folder}/bucket__={b}" for b in sorted(filled)}})


def read(spark: SparkSession, path: str, version: str | None = None, only: set[int] | None = None) -> DataFrame:
    """The rows of a version (the newest one), of the given buckets or of all."""
    m = manifest_of(spark, path, version)
    folders = [f"{path}/{f}" for b, f in m["folders"].items() if only is None or int(b) in only]
    schema = StructType.fromJson(json.loads(m["schema"]))
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def change(spark: SparkSession, path: str, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> str:
    """A new version: merge(rows, changes) of the buckets that the keys of changes fall into; other buckets keep their files.

    merge must keep rows of other keys as they are. Versions before stay readable. The driver holds a name for each bucket.
    A run that fails leaves a folder that no manifest names; one writer at a time.
    """
    m = manifest_of(spark, path)
    key, buckets = m["key"], m["buckets"]
    touched = {r[0] for r in changes.select(_bucket(key, buckets)).distinct().collect()}
    if not touched:
        return versions(spark, path)[-1]
    rows = merge(read(spark, path, only=touched), changes).select(StructType.fromJson(json.loads(m["schema"])).fieldNames())
    folder, filled = _write(rows, key, buckets, path)
    if not filled <= touched:
        raise ValueError("merge has changed keys")
    folders = {b: f for b, f in m["folders"].items() if int(b) not in touched} | {str(b): f"{folder}/bucket__={b}" for b in filled}
    return _publish(spark, path, {**m, "folders": folders})
