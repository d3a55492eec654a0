"""Sources and sinks: readers with explicit schemas, tolerant column resolution, write-once sinks, digests."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.numeric import number

#: The raw observation log.
POSITIONS = (
    "id bigint, owner bigint, name string, category string, nav_status int, nav_status_str string, sog double, cog double, heading double, "
    "lat double, lon double, destination string, draught double, manoeuvre_str string, recorded_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz"
)


#: Owners whose numbers share a range when rows are numbered.
OWNERS = 100_000


def read(spark: SparkSession, path: str | list[str], kind: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
    """One scan over any number of files. Pickles are refused: they run code."""
    if kind not in ("parquet", "csv", "json", "orc"):
        raise ValueError(f"can't read {kind}")
    reader = spark.read.schema(schema) if schema else spark.read
    reader = reader.option("header", True) if kind == "csv" else reader
    return reader.format(kind).load(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def zipped_lines(spark: SparkSession, path: str, member: str) -> DataFrame:
    """Lines of one member of each zip file, as (path, line); an archive is read by one task, as its format asks."""

    def lines(batches):
        import io
        import zipfile

        import pandas as pd

        for batch in batches:
            for at, content in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(member) as f:
                    while part := f.readlines(1 << 20):
                        yield pd.DataFrame({"path": at, "line": [x.decode("utf-8", "replace").rstrip("\r\n") for x in part]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(lines, "path string, line string")


def zipped_csv(spark: SparkSession, path: str, member: str, schema: str) -> DataFrame:
    """The records of one member of each zip file, typed by schema; lines equal to its header, the names in order, go."""
    names = ",".join(T.StructType.fromDDL(schema).names)
    lines = zipped_lines(spark, path, member).where(F.lower(F.replace("line", F.lit('"'), F.lit(""))) != names.lower())
    return lines.where(F.trim("line") != "").select(F.from_csv("line", schema).alias("r")).select("r.*")


def plain(name: str) -> str:
    return re.sub("[^a-z0-9]", "", name.lower())


def resolved(df: DataFrame, wanted: dict[str, list[str]], required: set[str]) -> DataFrame:
    """Columns by any of their aliases, whatever their case and punctuation; a missing optional one is NULL."""
    there: dict[str, str] = {}
    for x in df.columns:
        there.setdefault(plain(x), x)
    out: list[Column] = []
    for name, aliases in wanted.items():
        found = next((there[plain(x)] for x in [name, *aliases] if plain(x) in there), None)
        if found is None and name in required:
            raise ValueError(f"missing column {name}; any of {[name, *aliases]} would do")
        out.append((F.col(f"`{found}`") if found else F.lit(None).cast("string")).alias(name))
    return df.select(out)


def standard_static(df: DataFrame) -> DataFrame:
    """Static and voyage messages: typed, in UTC, with rows lacking a date or owner dropped and eta_available set."""
    x = resolved(
        df,
        {"owner": ["mmsi", "userid"], "date": ["timestamp", "time", "recorded_at"], "eta": [], "destination": ["dest"], "draught": ["draft"], "ship_type": ["type"]},
        {"owner", "date"},
    )
    x = x.select(F.col("owner").try_cast("bigint").alias("owner"), F.col("date").try_cast("timestamp").alias("date"), "eta", "destination", number(F.col("draught")).alias("draught"), "ship_type")
    return x.where("owner is not null and date is not null").withColumn("eta_available", F.col("eta").isNotNull() & (F.trim(F.col("eta").cast("string")) != ""))


def standard_positions(df: DataFrame) -> DataFrame:
    """Position messages: typed, with an id that numbers all rows in the order (owner, date, place).

    Rows are numbered within their owner, and owners' counts are summed in the order of owners within ranges of them, so no
    task sorts them all.
    """
    from pyspark.sql import Window

    x = resolved(df, {"owner": ["mmsi", "userid"], "date": ["timestamp", "time", "recorded_at"], "lat": ["latitude"], "lon": ["longitude", "lng"], "sog": ["speed"], "cog": ["course"]}, {"owner", "date", "lat", "lon"})
    x = x.select(F.col("owner").try_cast("bigint").alias("owner"), F.col("date").try_cast("timestamp").alias("recorded_at"), *(number(F.col(c)).alias(c) for c in ("lat", "lon", "sog", "cog")))
    x = x.where("owner is not null and recorded_at is not null")
    order = ["recorded_at", "lat", "lon", "sog", "cog"]
    sizes = x.groupBy("owner").agg(F.count("*").alias("_n")).withColumn("_block", F.floor(F.col("owner") / OWNERS))
    blocks = sizes.groupBy("_block").agg(F.sum("_n").alias("_m"))
    blocks = blocks.select("_block", (F.sum("_m").over(Window.orderBy("_block")) - F.col("_m")).alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("_block").orderBy("owner")) - F.col("_n") + F.col("_first")
    starts = sizes.join(blocks, "_block").select("owner", before.alias("_before"))
    local = F.row_number().over(Window.partitionBy("owner").orderBy(*order))
    return x.withColumn("_local", local).join(starts, "owner").withColumn("id", (F.col("_before") + F.col("_local")).cast("bigint")).drop("_local", "_before")


def write_once(df: DataFrame, path: str, kind: str = "parquet", by: str | None = None) -> None:
    """A sink that refuses to overwrite."""
    writer = df.write.mode("error")
    (writer.partitionBy(by) if by else writer).format(kind).save(path)


def csv_text(df: DataFrame, digits: int = 12) -> DataFrame:
    """Doubles as text with that many significant digits, for a deterministic CSV."""
    doubles = {x for x, kind in df.dtypes if kind == "double"}
    return df.select(*(F.format_string(f"%.{digits}g", F.col(x)).alias(x) if x in doubles else F.col(x) for x in df.columns))


def manifest(df: DataFrame, path: str, **more: object) -> dict:
    """Names, types, row count and an order-free digest of a table, written beside it as one JSON row."""
    digest = F.sum(F.conv(F.substring(F.sha2(F.to_json(F.struct(*df.columns)), 256), 1, 12), 16, 10).cast("decimal(20,0)"))
    row = df.agg(F.count("*").alias("rows"), digest.alias("digest")).first()
    out = {"columns": dict(df.dtypes), "rows": row["rows"], "digest": str(row["digest"] or 0)} | more
    df.sparkSession.createDataFrame([(json.dumps(out, sort_keys=True),)], "value string").coalesce(1).write.mode("error").text(path)
    return out


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256, md5) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """Rows and bytes by file, from the metadata column: what a scan is split into."""
    return spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows"), F.max("_metadata.file_size").alias("bytes"))
