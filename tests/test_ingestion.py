"""Text input as real extracts carry it: dates, NaN, odd numbers, quoted CSV cells."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillroll.functions import coerce
from tillroll.operators import clean, rfm
from tillroll.sources.csv import read_retail_csv
from tillroll.sources.sinks import write_csv

DAY = dt.datetime(2010, 12, 1)
DATES = {
    "2010-12-01 08:26:00.123": DAY.replace(hour=8, minute=26, microsecond=123000),
    "2010-12-01T08:26:00Z": DAY.replace(hour=8, minute=26),
    "2010-12-01T00:00:00.000": DAY,
    "2010-12-01": DAY,
    "12/1/2010 8:26 AM": DAY.replace(hour=8, minute=26),
    "12/1/2010 8:26 PM": DAY.replace(hour=20, minute=26),
    "12/1/2010 8:26": DAY.replace(hour=8, minute=26),
    "1-Dec-2010": DAY,
    "1 December 2010": DAY,
    "Dec 1, 2010": DAY,
    "20101201": DAY,
    "2010-12-1": DAY,
    "2010-12-01 8:26": DAY.replace(hour=8, minute=26),
    "01.12.2010 08:26": DAY.replace(hour=8, minute=26),
    "2010/12/01 08:26:00": DAY.replace(hour=8, minute=26),
    "Feb 5 2011 3:04 PM": dt.datetime(2011, 2, 5, 15, 4),
    "20101201T082600": DAY.replace(hour=8, minute=26),
    "no date": None,
    "": None,
}


def test_dates(spark):
    df = spark.createDataFrame([(t,) for t in DATES], "InvoiceDate string")
    got = {r[0]: r[1] for r in df.select("InvoiceDate", coerce.timestamp_ntz(df)).collect()}
    assert got == DATES


def _dates(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "InvoiceDate string")
    return [r[0] for r in df.select(coerce.timestamp_ntz(df)).collect()]


def test_a_column_is_read_in_one_order_of_day_and_month(spark):
    day = [dt.datetime(2011, 2, 13), dt.datetime(2011, 2, 5), dt.datetime(2011, 12, 31, 8, 5)]
    assert _dates(spark, ["13/02/2011", "05/02/2011", "31/12/2011 8:05"]) == day
    assert _dates(spark, ["13-02-11", "5-2-2011"])[1] == dt.datetime(2011, 2, 5)
    month = [dt.datetime(2011, 2, 13), dt.datetime(2011, 5, 2), None]
    assert _dates(spark, ["02/13/2011", "05/02/2011", "1/32/2011"]) == month
    assert _dates(spark, ["05/02/2011", "06/02/2011"])[0] == dt.datetime(2011, 5, 2)  # both fit: month first
    # most values decide; the one that doesn't fit is missing, not read the other way
    assert _dates(spark, ["2/13/2011", "2/14/2011", "13/2/2011"])[2] is None
    # each separator is voted on alone
    assert _dates(spark, ["13/2/2011", "5/2/2011", "2-13-2011", "5-2-2011"])[1::2] == [
        dt.datetime(2011, 2, 5), dt.datetime(2011, 5, 2)]
    assert _dates(spark, ["13/2/2011 3:04 PM", "1/2/11 3:04 AM"]) == [
        dt.datetime(2011, 2, 13, 15, 4), dt.datetime(2011, 2, 1, 3, 4)]
    assert _dates(spark, []) == []


def test_numbers(spark):
    texts = {"1": 1.0, " 2.5 ": 2.5, "-3": -3.0, "1e3": 1000.0, ".5": 0.5, "NaN": None, "nan": None, "1d": None,
             "2f": None, "Infinity": None, "": None, "zz": None}
    df = spark.createDataFrame([(t,) for t in texts], "q string")
    assert {r[0]: r[1] for r in df.select("q", coerce.number(df, "q")).collect()} == texts
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "q double")
    assert [r[0] for r in nan.select(coerce.number(nan, "q")).collect()] == [1.0, None, None]


def test_nan_rows_drop_and_are_counted(spark):
    nan = float("nan")
    rows = [("1", "A", "x", 2.0, DAY, 1.5, 17850.0), ("2", "A", "x", nan, DAY, 1.5, 17850.0),
            ("3", "A", "x", 2.0, DAY, nan, 17850.0), ("4", "A", "x", 2.0, DAY, 1.5, nan)]
    raw = spark.createDataFrame(rows, "InvoiceNo string, StockCode string, Description string, Quantity double, "
                                      "InvoiceDate timestamp_ntz, UnitPrice double, CustomerID double")
    assert [(r.InvoiceNo, r.CustomerID, r.TotalPrice) for r in clean.clean_lines(raw).collect()] == [("1", "17850", 3.0)]
    audit = clean.clean_audit(raw).first()
    assert (audit.initial_rows, audit.cleaned_rows, audit.missing_customer_ids) == (4, 1, 1)


def test_customer_without_a_date_has_no_rfm_row(spark):
    raw = spark.createDataFrame(
        [("1", "A", "x", "2", "2010-12-01", "1.5", "7"), ("2", "A", "x", "2", "never", "1.5", "8")],
        "InvoiceNo string, StockCode string, Description string, Quantity string, InvoiceDate string, "
        "UnitPrice string, CustomerID string")
    lines = clean.clean_lines(raw)
    assert lines.count() == 2
    assert [r.CustomerID for r in rfm.rfm_raw(lines).collect()] == ["7"]


HEADER = "InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID\n"


@pytest.mark.parametrize("cell,want", [
    ('"SET OF 6 ""SPICE"", TINS"', 'SET OF 6 "SPICE", TINS'),
    ('"two\nlines"', "two\nlines"),
    ("ends in \\", "ends in \\"),
    ('"a, b"', "a, b"),
])
def test_quoted_cells(spark, tmpdir_path, cell, want):
    with open(f"{tmpdir_path}/a.csv", "w", newline="") as f:
        f.write(HEADER + f"1,A,{cell},2,2010-12-01,1.5,7\n2,B,next,1,2010-12-02,2.5,8\n")
    rows = read_retail_csv(spark, f"{tmpdir_path}/a.csv").orderBy("InvoiceNo").collect()
    assert [(r.InvoiceNo, r.Description, r.CustomerID) for r in rows] == [("1", want, "7"), ("2", "next", "8")]


def test_undecodable_bytes_read_as_latin(spark, tmpdir_path):
    with open(f"{tmpdir_path}/b.csv", "wb") as f:
        f.write(HEADER.encode() + b"1,A,caf\xe9,2,2010-12-01,1.5,7\n")
    assert read_retail_csv(spark, f"{tmpdir_path}/b.csv").first().Description == "café"


def test_csv_round_trip_keeps_every_row_and_date(spark, tmpdir_path):
    from tillroll.sources.tables import retail_lines
    lines = retail_lines(spark, "/root/testdata/sf0.001").withColumn(
        "Description", F.when(F.col("Description").isNotNull(), F.concat(F.lit('a "'), "Description", F.lit('",\n\\'))))
    write_csv(lines, f"{tmpdir_path}/out")
    back = clean.clean_lines(read_retail_csv(spark, f"{tmpdir_path}/out"))
    want = clean.clean_lines(lines)
    cols = ["InvoiceNo", "Description", "InvoiceDate", "CustomerID"]
    assert back.where("InvoiceDate is null").count() == 0
    assert want.select(*cols).exceptAll(back.select(*cols)).count() == 0
    assert back.count() == want.count()


def test_bytes_that_no_candidate_takes_are_dropped(spark, tmpdir_path):
    """Under three columns no candidate qualifies: the last-resort read keeps what can be decoded."""
    with open(f"{tmpdir_path}/c.csv", "wb") as f:
        f.write(b"InvoiceNo,Description\n1,caf\xe9 au lait\n2,plain\n")
    rows = {r.InvoiceNo: r.Description for r in read_retail_csv(spark, f"{tmpdir_path}/c.csv").collect()}
    assert rows == {"1": "caf au lait", "2": "plain"}


def test_load_or_default(spark, tmpdir_path):
    from tillroll.sources.csv import load_or_default
    default = spark.range(3)
    missing = f"{tmpdir_path}/none.csv"
    assert load_or_default(lambda: read_retail_csv(spark, missing), default, fallback=True) is default
    with pytest.raises(Exception):
        load_or_default(lambda: read_retail_csv(spark, missing), default)
    assert load_or_default(lambda: default, spark.range(1), fallback=True) is default


def test_report_and_json_sinks(spark, tmpdir_path):
    from tillroll.sources.sinks import write_json, write_report
    lines = spark.createDataFrame([(2, "two"), (1, "# one"), (3, "")], "line_no int, line string").repartition(3)
    write_report(lines, f"{tmpdir_path}/report")
    assert [r.value for r in spark.read.text(f"{tmpdir_path}/report").collect()] == ["# one", "two", ""]
    summary = spark.createDataFrame([("ok", 3, ["a ➔ b"], None)], "status string, n long, rules array<string>, gone string")
    write_json(summary, f"{tmpdir_path}/json")
    back = spark.read.json(f"{tmpdir_path}/json").first()
    assert (back.status, back.n, back.rules) == ("ok", 3, ["a ➔ b"])


def test_quote_state_of_a_line():
    from tillroll.sources.csv import leaves_inside
    cases = [(b'a,b', False, False), (b'"a,b', False, True), (b'"a""b', False, True), (b'"a"",b"', False, False),
             (b'5" pipe,x', False, False), (b'x,"5"" pipe', False, True), (b'end",b', True, False),
             (b'still', True, True), (b'end","again', True, True), (b'""', False, False), (b'"', True, False),
             (b'""', True, True), (b'a,""', False, False)]
    for line, before, after in cases:
        assert leaves_inside(line, b",", before) is after, line


@pytest.mark.parametrize("sep", [",", ";"])
@pytest.mark.parametrize("encoding", ["utf-8", "iso-8859-1"])
def test_files_are_split_inside_quoted_cells(spark, tmpdir_path, sep, encoding):
    """Ranges of a few hundred bytes that begin inside cells, records and even whole-range cells: every row comes back."""
    import csv as pycsv
    import random
    rng = random.Random(5)
    header = ["InvoiceNo", "Stock\nCode", "Description", "Quantity", "InvoiceDate"]
    rows = []
    for i in range(150):
        cell = "".join(rng.choice(["a", "é", '"', sep, "\n", "\n", " ", "x\r\ny"]) for _ in range(rng.randint(0, 40)))
        rows.append([str(i), rng.choice(["5\" pipe", "plain"]), cell * (40 if i % 50 == 7 else 1) or "-", "2", "2010-12-01"])
    for name, part in (("a.csv", rows[:90]), ("b.csv", rows[90:])):
        with open(f"{tmpdir_path}/{name}", "w", newline="", encoding=encoding) as f:
            out = pycsv.writer(f, delimiter=sep, lineterminator="\n")
            out.writerow(header)
            out.writerows(part)
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    for k, v in zip(keys, ("300", "1")):
        spark.conf.set(k, v)
    try:
        df = read_retail_csv(spark, tmpdir_path)
        assert df.rdd.getNumPartitions() > 10
        got = sorted(tuple(r) for r in df.collect())
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)
    assert df.columns == header

    def same(text):  # the parser reads every line break as one kind
        return text.replace("\r\n", "\n")

    assert [tuple(map(same, r)) for r in got] == sorted(tuple(map(same, r)) for r in rows)


def test_only_layouts_of_a_texts_shape_are_tried(spark):
    """No layout reads a text that its shape rules out, and a text has the shape of few layouts."""
    odd = ["12/1/10 8:26 pm", "1-dec-10", "Dec 1 2010 08:26:01.123", "20101201 082600", "20101201 08:26", "20101201082600",
           "20101201t082600", "+12010-1-1", "02010-1-1", "1/1/999", "-1/2/2010", "1.2.2010 8:5", "2010-12-01x"]
    df = spark.createDataFrame([(t,) for t in [*DATES, *odd]], "t string").cache()
    tried = F.lit(0)
    for f in coerce.DATE_FORMATS:
        shape = F.col("t").rlike(coerce.layout_shape(f))
        assert df.where(F.try_to_timestamp("t", F.lit(f)).isNotNull() & ~shape).isEmpty(), f
        tried = tried + shape.cast("int")
    assert df.agg(F.max(tried)).first()[0] <= 3


def test_each_record_is_parsed_once(spark, tmpdir_path):
    path = f"{tmpdir_path}/a.csv"
    with open(path, "w") as f:
        f.write('a,b,c\n1,"x ""y"", z",3\n4,5,6,7\n"p\nq",8\n')
    df = read_retail_csv(spark, path)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("from_csv") == 1
    assert sorted(map(tuple, df.collect()), key=str) == [("1", 'x "y", z', "3"), ("p\nq", "8", None)]
