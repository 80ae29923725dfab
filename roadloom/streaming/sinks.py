"""A sink of observed positions that holds each once, however often a batch fails and comes again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEY = ["external_id", "observed_at"]
#: Buckets of vehicles in a day: a batch is held against those it touches only.
BUCKETS = 16


def fresh_positions(batch: DataFrame, vehicles: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Rows of known vehicles (external_id) with an observed time, one for each vehicle and time, that are not stored yet.

    Of several rows of one vehicle and time one stays: the least by its other columns.
    """
    rest = [c for c in batch.columns if c not in KEY]
    known = batch.where("observed_at is not null").join(vehicles.select("external_id").distinct(), "external_id", "left_semi")
    one = known.groupBy(*KEY).agg(F.min(F.struct(*rest)).alias("r")).select(*KEY, *[f"r.`{c}`" for c in rest]) if rest else known.distinct()
    out = one.select(batch.columns)
    return out if stored is None else out.join(stored.select(*KEY), KEY, "left_anti")


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def ledger(spark: SparkSession, path: str) -> list[int]:
    """The batches that are stored whole: an empty file for each."""
    system, place = _files(spark, f"{path}/ledger")
    return sorted(int(s.getPath().getName()) for s in system.listStatus(place)) if system.exists(place) else []


def _mark(spark: SparkSession, path: str, batch_id: int) -> None:
    system, place = _files(spark, f"{path}/ledger/{batch_id}")
    system.create(place, True).close()


def stored_positions(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of all batches in the ledger, with day__ and bucket__; what a failed batch has left behind is not among them."""
    done = ledger(spark, path)
    parts = StructType.fromDDL("day__ date, bucket__ int, batch__ bigint")
    if not done:
        return spark.createDataFrame([], StructType([*schema.fields, *parts.fields])).drop("batch__")
    rows = spark.read.schema(StructType([*schema.fields, *parts.fields])).parquet(f"{path}/rows")
    marks = spark.range(done[0], done[-1] + 1).withColumnRenamed("id", "batch__")
    gone = sorted({*range(done[0], done[-1] + 1)} - {*done})
    return rows.join(F.broadcast(marks.where(~F.col("batch__").isin(gone)) if gone else marks), "batch__", "left_semi").drop("batch__")


def store_batch(batch: DataFrame, batch_id: int, path: str, vehicles: DataFrame) -> bool:
    """Store the fresh rows of a batch once; False where the ledger has it already.

    Rows lie by day, bucket of vehicles and batch. A batch that comes again after a failure writes the same folders over,
    then goes into the ledger, which makes its rows count in one step. Rows are held against stored ones of the days and
    buckets that the batch touches.
    """
    spark = batch.sparkSession
    if batch_id in ledger(spark, path):
        return False
    place = {"day__": F.to_date("observed_at"), "bucket__": F.pmod(F.xxhash64("external_id"), F.lit(BUCKETS)).cast("int")}
    rows = batch.persist()
    try:
        touched = rows.where("observed_at is not null").select(*[c.alias(n) for n, c in place.items()]).distinct()
        stored = stored_positions(spark, path, batch.schema).join(F.broadcast(touched), ["day__", "bucket__"], "left_semi")
        new = fresh_positions(rows, vehicles, stored).withColumns(place).withColumn("batch__", F.lit(batch_id).cast("long"))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day__", "bucket__", "batch__").parquet(f"{path}/rows")
    finally:
        rows.unpersist()
    _mark(spark, path, batch_id)
    return True


def persist_positions(stream: DataFrame, vehicles: DataFrame, path: str, checkpoint: str, tries: int = 3):
    """A started query that stores every batch of the stream; a failed write is tried again, then by the checkpoint's restart."""

    def run(batch: DataFrame, batch_id: int) -> None:
        for left in range(tries - 1, -1, -1):
            try:
                store_batch(batch, batch_id, path, vehicles)
                return
            except Exception:
                if not left:
                    raise

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
