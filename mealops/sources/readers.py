"""File readers. Each returns a lazy frame with a declared schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas

CSV_TIMESTAMP = "yyyy-MM-dd HH:mm:ss"


def _format(path: str, fmt: str | None) -> str:
    return fmt or ("csv" if ".csv" in path else "parquet")


def scan_orders(spark: SparkSession, glob: str, schema: T.StructType = schemas.ORDERS,
                fmt: str | None = None) -> DataFrame:
    """All order exports matching the glob, leading columns only, rows appended.

    One scan over the glob: pruning and filters reach the files."""
    reader = spark.read.schema(schema)
    if _format(glob, fmt) == "csv":
        reader = reader.option("header", True).option("timestampNTZFormat", CSV_TIMESTAMP)
        return reader.csv(glob).select(schema.fieldNames())
    return reader.parquet(glob).select(schema.fieldNames())


def append_frames(*frames: DataFrame, strict: bool = False) -> DataFrame:
    """Rows of all frames matched by column name. ``strict`` requires equal column sets,
    otherwise missing columns become NULL."""
    if not frames:
        raise ValueError("nothing to append")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=not strict), frames)


def scan_dist_shards(spark: SparkSession, glob: str, fmt: str | None = None) -> DataFrame:
    """Route-lookup shards with exact duplicate rows removed."""
    if _format(glob, fmt) == "csv":
        raw = read_csv_blank_null(spark, glob, schemas.DIST)
    else:
        raw = spark.read.schema(schemas.DIST).parquet(glob)
    return raw.distinct()


def read_csv_blank_null(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header where empty text means NULL."""
    return (spark.read.schema(schema).option("header", True).option("nullValue", "")
            .option("timestampNTZFormat", CSV_TIMESTAMP).csv(path))


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType,
                   row_names: bool = False) -> DataFrame:
    """CSV kept as text and typed column by column afterwards; a value that does not fit its
    type becomes NULL instead of failing the file. ``row_names`` drops a leading unnamed
    row-number column."""
    names = schema.fieldNames()
    raw_names = (["_row", *names] if row_names else names)
    raw = (spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in raw_names]))
           .option("header", True).option("enforceSchema", True).csv(path))
    typed = []
    for field in schema.fields:
        col = F.col(field.name)
        if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            col = F.try_to_timestamp(col).cast(field.dataType)
        elif not isinstance(field.dataType, T.StringType):
            col = col.try_cast(field.dataType)
        typed.append(col.alias(field.name))
    return raw.select(typed)


def read_station_weather(spark: SparkSession, path: str, sep: str = ",",
                         columns: list[str] = schemas.STATION_RAW) -> DataFrame:
    """Raw station file as text columns. ``sep=','`` is a CSV with header; ``sep=None`` means
    any run of blanks, header line dropped."""
    if sep is not None:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in columns])
        return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)
    lines = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p"))
    cells = lines.filter((F.get("p", F.lit(0)) != columns[0]) & (F.get("p", F.lit(0)) != ""))
    return cells.select([F.get("p", F.lit(i)).alias(n) for i, n in enumerate(columns)])


def read_daily_weather(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.schema(schemas.DAILY_WEATHER).option("header", True).csv(path))


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """Roster counts written earlier by ``write_table(active_at_ticks(...))``."""
    return (spark.read.schema(schemas.ROSTER30).parquet(path)
            .withColumn("date", F.to_date("tm")))
