"""Cleaning of raw retail lines and its audit (one pass, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions import coerce
from tillroll.functions.schema import normalize_columns, validate_columns


def _prepared(raw: DataFrame) -> DataFrame:
    df = validate_columns(normalize_columns(raw))
    return df.withColumns({
        "CustomerID": coerce.customer_id_text(df),
        "Description": coerce.nan_to_null(df, "Description"),
        "InvoiceDate": coerce.timestamp_ntz(df),
        "InvoiceNo": coerce.invoice_text(df),
        "Quantity": coerce.number(df, "Quantity"),
        "UnitPrice": coerce.number(df, "UnitPrice"),
    })


def _present() -> Column:
    return F.col("CustomerID").isNotNull() & F.col("Description").isNotNull()


def _cancelled() -> Column:
    # case-sensitive prefix test; a null invoice is never a cancellation
    return F.coalesce(F.col("InvoiceNo").startswith("C"), F.lit(False))


def clean_lines(raw: DataFrame) -> DataFrame:
    """Cleaned lines: customer and description present, not cancelled,
    Quantity > 0 and UnitPrice > 0 (null values drop), plus TotalPrice.

    Extra input columns are carried through. The filters are row-local, so they
    fuse with the scan in one codegen stage and push down to Parquet where the
    source columns allow.
    """
    df = _prepared(raw)
    return (df.filter(_present() & ~_cancelled()
                      & (F.col("Quantity") > 0) & (F.col("UnitPrice") > 0))
              .withColumn("TotalPrice", F.col("Quantity") * F.col("UnitPrice")))


def clean_audit(raw: DataFrame) -> DataFrame:
    """One-row audit with the step-wise counts of the cleaning.

    Missing figures count raw rows (they overlap); cancellations count rows
    left after the null drop; invalid quantity/price counts rows left after
    the cancellation drop; rows with an unparseable quantity or price are
    dropped but counted nowhere. One aggregate pass, map-side partials only.
    """
    df = _prepared(raw)
    kept = _present() & ~_cancelled()
    invalid = (F.col("Quantity") <= 0) | (F.col("UnitPrice") <= 0)
    valid = (F.col("Quantity") > 0) & (F.col("UnitPrice") > 0)
    agg = df.agg(
        F.count(F.lit(1)).alias("initial_rows"),
        F.count_if(kept & valid).alias("cleaned_rows"),
        F.count_if(F.col("CustomerID").isNull()).alias("missing_customer_ids"),
        F.count_if(F.col("Description").isNull()).alias("missing_descriptions"),
        F.count_if(_present() & _cancelled()).alias("canceled_invoices"),
        F.count_if(kept & F.coalesce(invalid, F.lit(False))).alias("invalid_qty_or_price"),
    )
    return agg.withColumn(
        "retention_rate_pct",
        F.round(F.col("cleaned_rows") / F.greatest(F.col("initial_rows"), F.lit(1)) * 100, 2))
