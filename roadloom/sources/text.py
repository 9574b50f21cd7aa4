"""Text sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from roadloom.functions.columns import wkt_points

# Encodings in the order in which they are tried.
ENCODINGS = ["utf-8-sig", "utf-8", "gb18030", "gbk", "cp936"]


def encoding_of(spark: SparkSession, path: str, size: int = 1 << 16) -> str:
    """The first encoding that reads the file's beginning and finds a Chinese character, else the first that reads it.

    Spark reads the bytes, so the file may be in any store; only `size` of them reach the driver.
    """
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, size).alias("b")).first()["b"]
    readable = []
    for name in ENCODINGS:
        for cut in range(4):  # a character may be cut at the end
            try:
                text = bytes(head[: len(head) - cut]).decode(name)
            except UnicodeDecodeError:
                continue
            if any("一" <= c <= "鿿" for c in text):
                return name
            readable.append(name)
            break
    return readable[0] if readable else "utf-8"


def csv_table(spark: SparkSession, path: str, schema: StructType | str, encoding: str = "utf-8") -> DataFrame:
    """A CSV file with a header; columns that a query leaves out are not parsed."""
    if not encoding.startswith("utf-8"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # else Spark 4 reads Unicode encodings and Latin-1 alone
    return spark.read.option("header", True).option("encoding", "utf-8" if encoding == "utf-8-sig" else encoding).schema(schema).csv(path)


def wkt_table(df: DataFrame, column: str = "geometry") -> DataFrame:
    """Lines from WKT text; texts that are no line are dropped."""
    return df.withColumn(column, wkt_points(F.col(column))).where(F.col(column).isNotNull())


def as_markdown(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as lines of a Markdown table, for small reports."""
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), F.lit(" |")).alias("value"))


def as_geojson(df: DataFrame, geom: str, properties: list[str]) -> DataFrame:
    """A GeoJSON feature for each row, one a line."""
    coordinates = F.transform(geom, lambda p: F.array(p.getField("x"), p.getField("y")))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates")).alias("geometry"))
    return df.select(F.to_json(feature).alias("value"))
