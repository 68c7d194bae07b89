"""Readers and writers of the engine's inputs and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PING_COLUMNS = ("user_id long", "ts long", "lon double", "lat double", "accuracy double", "zipcode int")


def read_pings(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Pings of (gzipped) CSV files without a header; malformed rows go. Gzip does not split, so give ``partitions`` for few large files."""
    names = [c.split()[0] for c in PING_COLUMNS]
    raw = spark.read.schema(", ".join(f"{n} string" for n in names)).option("mode", "PERMISSIVE").csv(path)
    typed = raw.select(*(F.expr(f"try_cast({c.split()[0]} as {c.split()[1]})").alias(c.split()[0]) for c in PING_COLUMNS)).dropna()
    return typed.repartition(partitions) if partitions else typed


def month_days(spark: SparkSession, month: str) -> DataFrame:
    """The days of a month given as yyyy-MM."""
    first = F.to_date(F.lit(f"{month}-01"))
    return spark.range(1).select(F.explode(F.sequence(first, F.last_day(first))).alias("day"))


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


RING = "array<array<double>>"


def read_zones(spark: SparkSession, path: str, id_property: str) -> DataFrame:
    """The polygons of GeoJSON files, a row each: zone_id, ring_id (its number in the zone), rings, and its box.

    rings: arrays of (lon, lat), the border first, then the holes. Polygon and MultiPolygon features are read
    from the same file; other geometries and features without one have no zone. ``path`` may be a folder of files.
    """
    schema = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"
    features = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")  # the coordinates' own JSON text, for their depth differs
    polygons = F.when(kind == "Polygon", F.array(F.from_json(text, f"array<{RING}>"))).when(kind == "MultiPolygon", F.from_json(text, f"array<array<{RING}>>"))
    rows = features.select(F.col("f.properties")[id_property].cast("long").alias("zone_id"), F.posexplode(polygons).alias("ring_id", "polygon"))
    rings = F.transform("polygon", lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))))
    return with_boxes(rows.select("zone_id", "ring_id", rings.alias("rings")))


def with_boxes(polygons: DataFrame) -> DataFrame:
    """Adds the borders' boxes; a table of single rings (ring) gets them as ``rings`` without holes."""
    if "rings" not in polygons.columns:
        polygons = polygons.withColumn("rings", F.array("ring")).drop("ring")

    def edge(least: bool, c: str):
        values = F.transform(F.col("rings")[0], lambda p: p[c])
        return F.array_min(values) if least else F.array_max(values)

    box = {f"{m}_{c}": edge(m == "min", c) for c in ("lon", "lat") for m in ("min", "max")}
    return polygons.withColumns(box)


def read_tracts(spark: SparkSession, path: str) -> DataFrame:
    """tract, population and income (k$) of a file of census features."""
    props = "struct<GEOID:string,B00001_001E:double,B06011_001E:double>"
    rows = spark.read.schema(f"features array<struct<properties:{props}>>").option("multiLine", True).json(path).select(F.explode("features.properties").alias("p"))
    return rows.select(F.col("p.GEOID").cast("long").alias("tract"), F.col("p.B00001_001E").alias("population"), (F.col("p.B06011_001E") / 1000).alias("income"))


def read_zip_population(spark: SparkSession, path: str) -> DataFrame:
    """Second and fourth column; header lines don't cast and go."""
    raw = spark.read.schema("a string, zone_id string, b string, population string").csv(path)
    return raw.select(F.expr("try_cast(zone_id as long)").alias("zone_id"), F.expr("try_cast(population as double)").alias("population")).dropna()


def read_survey_od(spark: SparkSession, path: str) -> DataFrame:
    from pingmill.operators.od import survey_demand

    raw = spark.read.schema("o_zone long, d_zone long, c2 string, c3 string, drive_alone double, shared_ride double").option("header", True).csv(path)
    return survey_demand(raw)


def write_zones(zones: DataFrame, extra: DataFrame, path: str) -> None:
    """Zones with further attributes, as JSON lines."""
    zones.join(extra, "zone_id", "left").write.mode("overwrite").json(path)


def write_zone_file(zones: DataFrame, extra: DataFrame, path: str, id_property: str = "zone_id", per_file: int = 1000) -> None:
    """Zones with further attributes as GeoJSON files that ``read_zones`` reads, holes included.

    A zone is a MultiPolygon feature whose properties are its id and the columns of ``extra`` (zone_id, ...), where it has them.
    Files hold some ``per_file`` zones each, so no task holds all.
    """
    files = max(1, -(-zones.select("zone_id").distinct().count() // per_file))
    shape = F.transform(F.array_sort(F.collect_list(F.struct("ring_id", "rings"))), lambda p: F.transform(p["rings"], lambda ring: F.transform(ring, lambda q: F.array(q["lon"], q["lat"]))))
    whole = zones.groupBy("zone_id").agg(shape.alias("_shape")).join(extra, "zone_id", "left")
    properties = F.struct(F.col("zone_id").alias(id_property), *(c for c in extra.columns if c != "zone_id"))
    feature = F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.lit("MultiPolygon").alias("type"), F.col("_shape").alias("coordinates")).alias("geometry"))
    parts = whole.select(F.pmod(F.xxhash64("zone_id"), F.lit(files)).alias("part"), feature.alias("feature"))
    text = parts.groupBy("part").agg(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list("feature").alias("features"))).alias("value"))
    text.write.mode("overwrite").partitionBy("part").text(path)
