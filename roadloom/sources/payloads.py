"""Readers of feed payloads, route and stop catalogues, facility files and GeoJSON routes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from roadloom.functions.media import first_field
from roadloom.functions.scalars import num, plausible

#: Where payloads hold their items; the first that is there counts.
ITEM_PATHS = ("$.response.body.items.item", "$.response.body.items", "$.body.items.item", "$.body.items", "$.items.item", "$.items", "$.item")
_XML = "body struct<items struct<item array<map<string,string>>>>"


def _positive(c: Column) -> Column:
    v = num(c)
    return F.when(v > 0, v)


def parse_feed(df: DataFrame, raw: str = "raw") -> DataFrame:
    """df with `item`, a map of text fields, one row an item of its JSON or, where that finds none, XML payload.

    A single item may stand without its list. A payload without items gives no row.
    """
    found = F.coalesce(*[F.nullif(F.get_json_object(raw, p), F.lit("")) for p in ITEM_PATHS])
    many = F.when(F.startswith(found, F.lit("[")), found).when(F.startswith(found, F.lit("{")), F.concat(F.lit("["), found, F.lit("]")))
    xml = F.when(F.startswith(F.ltrim(F.col(raw)), F.lit("<")), F.from_xml(raw, _XML, {"mode": "PERMISSIVE"}).body.items.item)
    items = F.coalesce(F.from_json(many, "array<map<string,string>>"), xml)
    return df.withColumn("item", F.explode(items)).where("item is not null")


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    """line_no, line_id, seq and stop (a map of text fields) from a JSON object keyed by line."""
    doc = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,struct<line_id:string,stops:array<map<string,string>>>>")).alias("line_no", "r"))
    return doc.select("line_no", F.col("r.line_id").alias("line_id"), F.posexplode_outer("r.stops").alias("seq", "stop"))


def read_stop_catalog(spark: SparkSession, path: str) -> DataFrame:
    """arsno, bstopid, bstopnm, gpsx, gpsy with the version, complete and total_count of the catalogue they come from."""
    stop = "array<struct<arsno:string,bstopid:string,bstopnm:string,gpsx:double,gpsy:double>>"
    doc = spark.read.schema(f"version string, complete boolean, total_count long, stops {stop}").option("multiLine", True).json(path)
    return doc.select("version", "complete", "total_count", F.explode("stops").alias("s")).select("version", "complete", "total_count", "s.*")


def read_bridges(spark: SparkSession, path: str, region: str = "부산") -> DataFrame:
    """ref, lat, lon, height_m, width_m, weight_t of the pages of bridges or tunnels in a region; each axis from the start, else the end."""
    item = parse_feed(spark.read.text(path, wholetext=True).withColumnRenamed("value", "raw")).select("item")
    at = lambda *names: F.coalesce(*[_positive(F.element_at("item", n)) for n in names])
    df = item.where(F.contains(F.element_at("item", "sidoNm"), F.lit(region))).select(
        F.trim(F.element_at("item", "facilName")).alias("ref"), at("sLatitude", "eLatitude").alias("lat"), at("sLongitude", "eLongitude").alias("lon"),
        plausible(at("height"), 1.5, 6.0).alias("height_m"), plausible(at("totWidth"), 1.5, 30.0).alias("width_m"), at("alowPass").alias("weight_t"))
    return df.where("lat is not null and lon is not null")


@F.pandas_udf(StringType())
def _text(content: pd.Series) -> pd.Series:
    """UTF-8 where the bytes are valid, else CP949, which Spark's own decode does not know."""

    def one(b: bytes) -> str:
        try:
            return b.decode("utf-8-sig")
        except UnicodeDecodeError:
            return b.decode("cp949", "replace")

    return content.map(one)


def _decoded(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", _text("content").alias("text"))


def read_underpass(spark: SparkSession, path: str) -> DataFrame:
    """ref, lat, lon, height_m, width_m from CSV files in UTF-8 or CP949 whose columns are known by part of their name."""
    lines = _decoded(spark, path).select("path", F.split("text", "\r?\n").alias("l")).select("path", F.split(F.col("l")[0], ",").alias("head"), F.explode(F.expr("slice(l, 2, size(l))")).alias("line")).where("trim(line) <> ''")
    cells = F.map_from_entries(F.transform(F.arrays_zip(F.transform("head", F.trim).alias("k"), F.split("line", ",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)").alias("v")), lambda e: F.struct(F.coalesce(e.k, F.lit("")).alias("key"), F.trim(F.translate(e.v, '"', "")).alias("value"))))

    def cell(*parts: str, without: str | None = None) -> Column:
        hit = lambda e: F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(F.lower(e.key), p)) & (~F.contains(e.key, F.lit(without)) if without else F.lit(True))
        return F.get(F.filter(F.map_entries("m"), hit), F.lit(0)).value

    df = lines.select(cells.alias("m"))
    return df.select(cell("시설명", "명칭").alias("ref"), num(F.coalesce(cell("위도"), first_field(F.col("m"), "lat"))).alias("lat"), num(F.coalesce(cell("경도"), first_field(F.col("m"), "lon", "lng"))).alias("lon"), _positive(cell("높이")).alias("height_m"), _positive(cell("폭", without="보도")).alias("width_m"))


def read_widths(spark: SparkSession, path: str) -> DataFrame:
    """start_address, end_address, ref, width_m of the restricted widths; rows without both addresses or a plausible width go."""
    raw = spark.read.option("header", True).csv(path)
    start, end = F.trim("출발지 이름"), F.trim("도착지 이름")
    name = F.coalesce(F.nullif(F.trim("도로명칭"), F.lit("")), F.concat(start, F.lit(" ~ "), end))
    df = raw.select(start.alias("start_address"), end.alias("end_address"), name.alias("ref"), plausible(_positive(F.col("제한너비")), 1.5, 30.0).alias("width_m"))
    return df.where("start_address <> '' and end_address <> '' and width_m is not null")


def read_osm_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The decoded node, way and relation tables of a road network."""
    return {name: spark.read.parquet(f"{folder}/{name}") for name in ("nodes", "ways", "relations")}


def route_from_geojson(df: DataFrame, geojson: str = "geojson") -> DataFrame:
    """df with `line`, an array of (x, y), and is_current; the text stays as it is. Null where it is no LineString of two points or more."""
    g = F.from_json(geojson, "type string, coordinates array<array<double>>")
    line = F.transform(g.coordinates, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    whole = (g.type == "LineString") & (F.size(line) > 1) & ~F.exists(line, lambda p: p.x.isNull() | p.y.isNull())
    return df.withColumn("line", F.when(whole, line)).withColumn("is_current", F.lit(True))


def save_route(df: DataFrame, path: str, geojson: str = "geojson") -> None:
    """Append routes, each as its display text and as its line; rows without a valid line are left out."""
    route_from_geojson(df, geojson).where("line is not null").write.mode("append").parquet(path)
