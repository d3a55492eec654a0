"""Configurations from JSON, and scoring bundles as folders of Parquet tables and MLlib models."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = "type string, features array<struct<type: string, properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>"


def geometries(spark: SparkSession, path: str) -> DataFrame:
    """(name, kind, corners) of a GeoJSON feature collection's lines and polygons (outer rings), as array<struct<lon, lat>>."""
    x = spark.read.schema(FEATURES).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    ring, line = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")[0], F.from_json("f.geometry.coordinates", "array<array<double>>")
    pairs = F.when(F.col("f.geometry.type") == "Polygon", ring).when(F.col("f.geometry.type") == "LineString", line)
    return x.select(F.col("f.properties")["name"].alias("name"), F.col("f.geometry.type").alias("kind"), F.transform(pairs, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))).alias("corners"))


def medians(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a JSON object of numbers: a small dimension table."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, double>")).alias("key", "value"))


def save(path: str, tables: dict[str, DataFrame], models: dict[str, PipelineModel], config: dict) -> None:
    """A bundle: tables, models and the configuration; nothing is pickled, and nothing is overwritten."""
    spark = SparkSession.active()
    for name, df in tables.items():
        df.write.mode("error").parquet(f"{path}/tables/{name}")
    for name, model in models.items():
        model.save(f"{path}/models/{name}")
    text = json.dumps({"tables": sorted(tables), "models": sorted(models), "config": config}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("error").text(f"{path}/bundle")


def load(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict[str, PipelineModel], dict]:
    index = json.loads(spark.read.text(f"{path}/bundle").first()["value"])
    return {x: spark.read.parquet(f"{path}/tables/{x}") for x in index["tables"]}, {x: PipelineModel.load(f"{path}/models/{x}") for x in index["models"]}, index["config"]
