import json

from pyspark.sql import functions as F

from roadloom.functions import scalars
from roadloom.operators.roadnet import merge_overrides
from roadloom.sources import tables
from roadloom.streaming.windows import event_rates, new_positions, stream_feed


def test_overrides_and_precedence(spark, tmp_path):
    p = tmp_path / "o.json"
    p.write_text(json.dumps({"_readme": {"a": "b"}, "12": {"maxheight": "3.5", "note": "x"}, "13": {"note": "y"}}))
    got = tables.read_overrides(spark, str(p)).collect()
    assert [(r.way_id, r.maxheight) for r in got] == [(12, "3.5")]
    gov = spark.createDataFrame([(1, 3.0, None), (2, 4.0, 10.0)], "way_id long, h double, w double")
    man = spark.createDataFrame([(2, None, 5.0)], "way_id long, h double, w double")
    assert sorted(map(tuple, merge_overrides(gov, man).collect())) == [(1, 3.0, None), (2, None, 5.0)]
    assert sorted(map(tuple, merge_overrides(gov, man, True).collect())) == [(1, 3.0, None), (2, 4.0, 5.0)]


def test_history_drops_bad_points(spark, tmp_path):
    (tmp_path / "h.csv").write_text("line_number,direction,trace_time_s,latitude,longitude\n111-1,out,1,35.1,129.1\n111-1,out,2,91,0\n111-1,out,3,invalid,1\n")
    assert tables.read_history(spark, str(tmp_path / "h.csv")).count() == 1


def test_scalars(spark):
    df = spark.createDataFrame([(" 10 0-1 ", "OUT", "1,234.5", "123", "3.5 m")], "a string, b string, c string, d string, e string")
    r = df.select(scalars.norm_line(F.col("a")), scalars.norm_direction(F.col("b")), scalars.num(F.col("c")), scalars.ars_id(F.col("d")), scalars.limit_tag(F.col("e"))).first()
    assert tuple(r) == ("100-1", "outbound", 1234.5, "00123", 3.5)


def test_streams(spark, tmp_path):
    rows = [("A", "2024-01-01 00:00:01"), ("A", "2024-01-01 00:00:01"), ("B", "2024-01-01 00:00:02"), ("Z", "2024-01-01 00:00:03")]
    df = spark.createDataFrame(rows, "external_id string, t string").select("external_id", F.col("t").cast("timestamp").alias("observed_at"), F.lit(1).alias("vehicle_id"))
    df.write.parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([("A",), ("B",)], "external_id string")
    s = stream_feed(spark, str(tmp_path / "in"), df.schema, "parquet")
    for name, out, mode in (("fresh", new_positions(s, known), "append"), ("rates", event_rates(s, "observed_at"), "complete")):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("fresh").count() == 2 and spark.table("rates").agg(F.max("n")).first()[0] == 4
