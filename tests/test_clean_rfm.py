"""Golden fixture for cleaning, audit and RFM (hand-computed)."""

import pytest
from pyspark.sql import functions as F

from tillroll.operators import clean, rfm

COLS = ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID"]
ROWS = [
    ("1001", "A", "apple", "2", "2024-01-01 23:30", "1.50", "17850.0"),
    ("1001", "B", "bread", "1", "2024-01-01 23:30", "2.00", "17850.0"),
    ("C1002", "A", "apple", "-1", "2024-01-02 10:00", "1.50", "17850.0"),
    ("1003", "A", "apple", "3", "2024-01-03 09:00", "1.50", None),
    ("1004", "B", None, "1", "2024-01-03 09:00", "2.00", "12347"),
    ("1005", "A", "apple", "0", "2024-01-04 09:00", "1.50", "12347"),
    ("1006", "B", "bread", "1", "2024-01-05 09:00", "-1.0", "12347"),
    ("1007", "B", "bread", "zz", "2024-01-05 09:00", "2.00", "12347"),
    ("1008", "A", "apple", "4", "2024-01-10 23:00", "1.50", "12347"),
    ("c1009", "A", "apple", "1", "2024-01-09 12:00", "1.50", "12347"),
    ("1010", "A", None, "1", "2024-01-09 12:00", "1.50", None),
]


@pytest.fixture
def raw(spark):
    return spark.createDataFrame(ROWS, ",".join(f"{c} string" for c in COLS))


def test_audit(raw):
    a = clean.clean_audit(raw).first().asDict()
    assert a == {"initial_rows": 11, "cleaned_rows": 4, "missing_customer_ids": 2,
                 "missing_descriptions": 2, "canceled_invoices": 1, "invalid_qty_or_price": 2,
                 "retention_rate_pct": 36.36}


def test_clean_lines(raw):
    c = clean.clean_lines(raw)
    got = sorted((r.InvoiceNo, r.StockCode, r.TotalPrice, r.CustomerID) for r in c.collect())
    assert got == [("1001", "A", 3.0, "17850"), ("1001", "B", 2.0, "17850"),
                   ("1008", "A", 6.0, "12347"), ("c1009", "A", 1.5, "12347")]


def test_rfm_whole_days(raw):
    r = {x.CustomerID: (x.Recency, x.Frequency, x.Monetary)
         for x in rfm.rfm_raw(clean.clean_lines(raw)).collect()}
    assert r == {"17850": (9, 1, 5.0), "12347": (1, 2, 7.5)}


def test_rfm_scaled(raw):
    s = {x.CustomerID: (round(x.Recency, 6), round(x.Frequency, 6), round(x.Monetary, 6))
         for x in rfm.rfm_scaled(rfm.rfm_raw(clean.clean_lines(raw))).collect()}
    assert s == {"17850": (1.0, -1.0, -1.0), "12347": (-1.0, 1.0, 1.0)}


def test_zero_spread_scales_to_zero(spark):
    df = spark.createDataFrame([("a", 1, 2, 3.0), ("b", 1, 5, 4.0)],
                               "CustomerID string, Recency long, Frequency long, Monetary double")
    out = {r.CustomerID: r.Recency for r in rfm.rfm_scaled(df).collect()}
    assert out == {"a": 0.0, "b": 0.0}


def test_header_aliases_and_errors(spark):
    from tillroll.functions.schema import normalize_columns, validate_columns
    df = spark.createDataFrame([("1", "a", "b", "1", "2024-01-01", "1", "2")],
                               [" Invoice ", "SKU", "product_name", "Qty", "date", "Price", "cust-id"])
    assert normalize_columns(df).columns == COLS
    dup = spark.createDataFrame([("1", "2", "x", "y", "z")], ["qty", "Quantity", "a", "b", "c"])
    with pytest.raises(ValueError, match="both map"):
        normalize_columns(dup)
    with pytest.raises(ValueError, match="UnitPrice"):
        validate_columns(normalize_columns(df.drop("Price")))


def test_customer_id_from_double(spark):
    df = spark.createDataFrame([("1", "a", "d", 1.0, "2024-01-01", 1.0, 12345678.0)],
                               "InvoiceNo string, StockCode string, Description string, Quantity double, "
                               "InvoiceDate string, UnitPrice double, CustomerID double")
    assert clean.clean_lines(df).first().CustomerID == "12345678"


def test_null_invoice_is_nan_text(spark):
    df = spark.createDataFrame([(None, "a", "d", "1", "2024-01-01", "1", "5")],
                               ",".join(f"{c} string" for c in COLS))
    assert clean.clean_lines(df).first().InvoiceNo == "nan"
    assert F is not None
