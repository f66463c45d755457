"""Line-local operators on streams of text: the parsers keep no state, so a stream takes the same plan as a file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.sources import gtf, impute2


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """New files of a folder as they come."""
    return spark.readStream.text(folder)


def stream_gtf(spark: SparkSession, folder: str, mode: str = "PERMISSIVE") -> DataFrame:
    lines = read_lines(spark, folder)
    return gtf.parse(lines.where(~F.col("value").startswith("#") & (F.length("value") > 0)), mode=mode)


def stream_dosages(spark: SparkSession, folder: str, prob_threshold: float = 0.0) -> DataFrame:
    return impute2.dosages(impute2.parse(read_lines(spark, folder), mode="DROPMALFORMED"), prob_threshold)
