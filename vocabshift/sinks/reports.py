"""Report sink: one written table per report (the reference's workbook sheets)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import to_camel_case


def write_reports(
    reports: Mapping[str, DataFrame],
    path: str,
    project: str = "",
    fmt: str = "parquet",
    camel_case: bool = False,
    mode: str = "overwrite",
) -> dict[str, str]:
    """Write each report to ``<path>/<project><name>``; returns the paths.

    Reports arrive sorted; Spark keeps that order across the written part
    files.  CSV output gets a header row.
    """
    out = {}
    for name, df in reports.items():
        target = f"{path.rstrip('/')}/{project}{name}"
        data = to_camel_case(df) if camel_case else df
        writer = data.write.mode(mode).format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.save(target)
        out[name] = target
    return out


def read_report(spark, path: str, fmt: str = "parquet") -> DataFrame:
    """Read one written report back."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", False)
    return reader.load(path)


def written_places(spark: SparkSession, path: str, name: str = "place") -> DataFrame:
    """A written Parquet report with the place (from 1) of every row in the order it was written in.

    Part files are ordered by name.  The rows of each file are counted, which gives the rows before it, and a row's place
    is that plus its index in its file, which Parquet's reader knows; so files and splits are read side by side, and the
    only window is over one row a file.
    """
    rows = read_report(spark, path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    files = rows.groupBy("_file").agg(F.count("*").alias("_rows"))
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    before = files.select(F.col("_file").alias("_of"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    placed = rows.join(before, F.col("_file") == F.col("_of"))
    return placed.withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_file", "_of", "_at", "_before")
