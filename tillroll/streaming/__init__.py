"""Streaming entry points.

The engine has no stateful streaming operator (the workload is batch). The
cleaning step is row-local, so ``clean_lines`` applies unchanged to a
``readStream`` source; ``clean_stream`` wires that up for CSV drops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tillroll.functions.schema import REQUIRED_COLUMNS
from tillroll.operators.clean import clean_lines


def clean_stream(spark: SparkSession, folder: str, sep: str = ",") -> DataFrame:
    """Streaming DataFrame of cleaned lines from CSV files arriving in ``folder``."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in REQUIRED_COLUMNS])
    raw = spark.readStream.schema(schema).option("header", True).option("sep", sep).csv(folder)
    return clean_lines(raw)
