"""CSV cases and synthetic-source properties."""

import os

import pytest
from pyspark.sql import functions as F

from tillroll.sources.csv import read_retail_csv
from tillroll.sources.synthetic import synthetic_retail

HEADER = ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID"]


def _write(path, text, encoding="utf-8"):
    with open(path, "wb") as f:
        f.write(text.encode(encoding))
    return path


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_separators(spark, tmpdir_path, sep):
    body = sep.join(HEADER) + "\n" + sep.join(["1", "A", "apple", "2", "2024-01-01", "1.5", "7"]) + "\n"
    df = read_retail_csv(spark, _write(os.path.join(tmpdir_path, "a.csv"), body))
    assert df.columns == HEADER and df.count() == 1


def test_latin1_and_rows(spark, tmpdir_path):
    lines = [",".join(HEADER),
             "1,A,crème brûlée,2,2024-01-01,1.5,7",
             "2,B,extra,1,2024-01-01,1.0,8,SURPLUS",        # too many fields: dropped
             "3,C,short,1,2024-01-01,1.0",                  # missing field: kept, null
             "4,D,NA,NaN,2024-01-01,1.0,9"]                 # NA tokens: null
    p = _write(os.path.join(tmpdir_path, "l.csv"), "\n".join(lines) + "\n", "iso-8859-1")
    rows = {r.InvoiceNo: r for r in read_retail_csv(spark, p).collect()}
    assert set(rows) == {"1", "3", "4"}
    assert rows["1"].Description == "crème brûlée"
    assert rows["3"].CustomerID is None
    assert rows["4"].Description is None and rows["4"].Quantity is None


def test_too_few_columns_falls_back(spark, tmpdir_path):
    p = _write(os.path.join(tmpdir_path, "n.csv"), "a:b\n1:2\n")
    df = read_retail_csv(spark, p)
    assert len(df.columns) < 3


def test_aliased_headers_clean(spark, tmpdir_path):
    from tillroll.operators.clean import clean_lines
    body = " Invoice ;SKU;product_name;Qty;date;Price;cust-id\n1;A;apple;2;2024-01-01 10:00;1.5;7\n"
    df = clean_lines(read_retail_csv(spark, _write(os.path.join(tmpdir_path, "h.csv"), body)))
    r = df.first()
    assert (r.InvoiceNo, r.Description, r.Quantity, r.TotalPrice, r.CustomerID) == ("1", "apple", 2.0, 3.0, "7")


def test_row_cap(spark, tmpdir_path):
    body = ",".join(HEADER) + "\n" + "".join(f"{i},A,x,1,2024-01-01,1,7\n" for i in range(20))
    assert read_retail_csv(spark, _write(os.path.join(tmpdir_path, "c.csv"), body), row_cap=5).count() == 5


def test_synthetic_exact_rows_and_partitioning(spark):
    a = synthetic_retail(spark, 1500, seed=42, num_partitions=1)
    b = synthetic_retail(spark, 1500, seed=42, num_partitions=6)
    assert a.count() == 1500
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_synthetic_rates_and_bundles(spark):
    from tillroll.operators import baskets, clean, mining, rules
    df = synthetic_retail(spark, 20000, seed=42)
    n = df.count()
    stats = df.agg(F.avg(F.col("CustomerID").isNull().cast("int")).alias("nul"),
                   F.avg(F.col("InvoiceNo").startswith("C").cast("int")).alias("can"),
                   F.avg((F.col("UnitPrice") < 0).cast("int")).alias("bad")).first()
    assert n == 20000
    assert 0.06 < stats.nul < 0.10 and 0.02 < stats.can < 0.04 and 0.005 < stats.bad < 0.015
    c = clean.clean_lines(df)
    its = mining.fpgrowth_itemsets(baskets.basket_arrays(c), 0.02)
    rl = rules.association_rules(its, "confidence", 0.2).collect()
    assert rl and all(r.lift > 1.5 for r in rl)
