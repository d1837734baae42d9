"""Readers of files, at rest and as streams, and writers that replace what they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GEOJSON = "features array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table of CSV (with header), JSON lines or Parquet, by the ending of its path."""
    reader = spark.read.schema(schema) if schema else spark.read
    if path.endswith((".csv", ".csv.gz")):
        return reader.csv(path, header=True, inferSchema=schema is None)
    if path.endswith((".json", ".jsonl", ".json.gz", ".jsonl.gz")):
        return reader.json(path)
    return reader.parquet(path)


def read_geojson(spark: SparkSession, path: str, id_key: str = "id") -> DataFrame:
    """``feature_id, kind, xs, ys, properties`` of the features of a collection: a point, a line, or a polygon's outer ring without its end."""
    features = spark.read.schema(GEOJSON).json(path, multiLine=True).select(F.explode("features").alias("f"))
    text = F.col("f.geometry.coordinates")
    kind = F.col("f.geometry.type")
    nested = "array<array<double>>"
    ring = F.get(F.from_json(text, f"array<{nested}>"), F.lit(0))
    points = (
        F.when(kind == "Polygon", F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))))
        .when(kind == "LineString", F.from_json(text, nested))
        .when(kind == "Point", F.array(F.from_json(text, "array<double>")))
    )
    axis = lambda i: F.transform("points", lambda p: F.get(p, F.lit(i)))
    return features.select(F.element_at("f.properties", F.lit(id_key)).alias("feature_id"), kind.alias("kind"), points.alias("points"), F.col("f.properties").alias("properties")).select(
        "feature_id", "kind", axis(0).alias("xs"), axis(1).alias("ys"), "properties"
    )


def message_stream(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """Messages (payload, rx_time) as a stream of text files that something else drops in ``path``, one message to a line."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_at_once).text(path)
    return lines.select(F.col("value").alias("payload"), F.col("_metadata.file_modification_time").alias("rx_time"))


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Write ``rows`` in place of the partitions (values of ``by``) that they have; the others stay."""
    rows.write.partitionBy(*by).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def export_csv(rows: DataFrame, path: str, order: list[str]) -> None:
    """Rows in order as CSV files with headers; the newest run replaces the one before."""
    rows.orderBy(*order).write.mode("overwrite").csv(path, header=True)
