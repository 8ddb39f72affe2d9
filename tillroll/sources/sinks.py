"""Sinks: CSV template, text report, JSON result."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", sep: str = ",", encoding: str = "UTF-8") -> None:
    """CSV with a header line, one file per partition; quotes are doubled, so ``read_retail_csv`` gets the rows back."""
    (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
     .option("sep", sep).option("encoding", encoding)
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
     .csv(path))


def write_report(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Report lines ``(line_no, line)`` as one text file in line order.

    A report is a few dozen lines, so a single ordered partition is right here.
    """
    lines.orderBy("line_no").select("line").coalesce(1).write.mode(mode).text(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines (e.g. the one-row analyze summary)."""
    df.write.mode(mode).json(path)
