"""Change sets against a full rebuild with untouched files kept; merged sketches against exact ranks."""

import os

import pytest
from pyspark.sql import functions as F

from roadloom.operators import history, roadnet, sketches
from roadloom.sources import versions

VEHICLES = "vehicle_source string, external_id string, vehicle_code string, vehicle_status string"


def files(path):
    return {os.path.join(d, n) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_change_sets_equal_a_rebuild(spark, tmp_path):
    path, key = str(tmp_path / "t"), ["vehicle_source", "external_id"]
    dim = spark.createDataFrame([("BIMS", f"x{i}", f"V{i}", "READY") for i in range(200)], VEHICLES)
    first = versions.create(dim, path, key, 16)
    seen = "vehicle_source string, external_id string, vehicle_status string"
    sets = [spark.createDataFrame(rows, seen) for rows in ([("BIMS", "x3", "DRIVING"), ("BIMS", "new1", "READY")], [("BIMS", "x3", "STOPPED")], [("CUSTOM", "x3", "READY"), ("BIMS", "new1", "OFFLINE")])]
    whole = dim
    for s in sets:
        before, names = versions.manifest_of(spark, path)["folders"], files(path)
        versions.change(spark, path, s, history.upsert_vehicles)
        whole = history.upsert_vehicles(whole, s)
        after = versions.manifest_of(spark, path)["folders"]
        touched = {b for b in after if before.get(b) != after[b]}
        assert 0 < len(touched) <= s.count() and names <= files(path)
        assert sorted(map(tuple, versions.read(spark, path).select(whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    assert len(versions.versions(spark, path)) == 4
    assert sorted(map(tuple, versions.read(spark, path, first).collect())) == sorted(map(tuple, dim.collect()))


def test_patch_remove_and_failed_merge(spark, tmp_path):
    path = str(tmp_path / "t")
    dim = spark.createDataFrame([(i, "a", float(i)) for i in range(50)], "way_id long, h string, w double")
    versions.create(dim, path, ["way_id"], 8)
    changes = spark.createDataFrame([(1, "b", None), (2, None, 9.0)], "way_id long, h string, w double")
    versions.change(spark, path, changes, lambda rows, c: history.patch(rows, c, "way_id"))
    versions.change(spark, path, spark.createDataFrame([(3,)], "way_id long"), lambda rows, c: history.remove(rows, c, "way_id"))
    manual = spark.createDataFrame([(4, None, 5.0), (99, "z", None)], "way_id long, h string, w double")
    versions.change(spark, path, manual, lambda rows, c: roadnet.merge_overrides(rows, c))
    got = {r.way_id: (r.h, r.w) for r in versions.read(spark, path).collect()}
    assert got == {**{i: ("a", float(i)) for i in range(50) if i != 3}, 1: ("b", 1.0), 2: ("a", 9.0), 4: (None, 5.0), 99: ("z", None)}
    n = versions.versions(spark, path)
    with pytest.raises(Exception):  # noqa: B017 (whatever the write raises)
        versions.change(spark, path, changes, lambda rows, c: rows.withColumn("h", F.raise_error(F.lit("broken"))))
    with pytest.raises(ValueError):
        versions.change(spark, path, spark.createDataFrame([(7,)], "way_id long"), lambda rows, c: rows.withColumn("way_id", F.col("way_id") + 1000))
    assert versions.versions(spark, path) == n and versions.change(spark, path, changes.limit(0), None) == n[-1]


def test_merged_quantiles(spark, tmp_path):
    path = str(tmp_path / "s")
    raw = spark.range(90_000).select((F.col("id") % 3).alias("model"), F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, cast(id % 31 as int))").alias("at"), F.when(F.col("id") % 10 > 0, F.pow(F.rand(7) * 100, 2)).alias("ms"))
    raw.write.parquet(str(tmp_path / "raw"))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    sketches.store_days(sketches.day_sketches(raw, ["model"], "at", "ms"), path)
    sketches.store_days(sketches.day_sketches(raw.where("at < timestamp '2024-01-03'"), ["model"], "at", "ms"), path)  # two days again
    for start, end in ((None, None), ("2024-01-05", "2024-01-11")):
        got = {r.model: r for r in sketches.quantiles(sketches.stored_days(spark, path), ["model"], {"p50": 0.5, "p99": 0.99}, start, end).collect()}
        for m in range(3):
            values = sorted(r.ms for r in raw.where(f"model = {m} and ms is not null and to_date(at) between '{start or '2000-01-01'}' and '{end or '2100-01-01'}'").collect())
            assert got[m].n == len(values) and (got[m].least, got[m].most) == (values[0], values[-1])
            for q, p in ((got[m].p50, 0.5), (got[m].p99, 0.99)):
                assert abs(sum(v <= q for v in values) / len(values) - p) <= 3 / sketches.K + 1 / len(values)
    assert "raw" not in sketches.quantiles(sketches.stored_days(spark, path), ["model"], {"p50": 0.5})._jdf.queryExecution().toString()
