"""Synthetic retail lines with co-purchase bundles and injected anomalies.

Every random draw is a hash of (seed, invoice, slot), so the rows are the
same at any partitioning and any cluster size; ``num_records`` may be
millions. Per invoice: a customer (missing with probability 0.08), a day of
2023, a bundle and 1..len(bundle) of its items without replacement. Per
line: with probability 0.03 a cancellation (``C`` prefix, quantity -1..-4),
else quantity 1..11. After truncation to ``num_records`` lines about 1 % of
prices are set to -1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.session import cut_lineage

# The seven co-purchase bundles as (stock code, description, price).
BUNDLES = [
    [("85123A", "WHITE HANGING HEART T-LIGHT HOLDER", 2.55),
     ("22423", "REGENCY CAKESTAND 3 TIER", 12.75),
     ("84879", "ASSORTED COLOUR BIRD ORNAMENT", 1.69)],
    [("20725", "LUNCH BAG RED RETROSPOT", 1.65),
     ("20727", "LUNCH BAG BLACK SKULL", 1.65),
     ("20728", "LUNCH BAG CARS BLUE", 1.65)],
    [("22383", "LUNCH BAG SUKI DESIGN", 1.65),
     ("22384", "LUNCH BAG PINK POLKADOT", 1.65)],
    [("22960", "JAM MAKING SET WITH JARS", 4.25),
     ("22961", "JAM MAKING SET PRINTED", 4.25),
     ("23310", "SET 3 RETROSPOT TEA,COFFEE,SUGAR", 4.95)],
    [("84991", "60 TEATIME MATCHES RD", 0.42),
     ("84992", "72 SWEETHEART FAIRY CAKE CASES", 0.55),
     ("21212", "PACK OF 60 PINK PAISLEY CAKE CASES", 0.55)],
    [("22720", "SET OF 3 CAKE TINS PANTRY DESIGN", 4.95),
     ("22722", "SET OF 6 SPICE TINS PANTRY DESIGN", 3.95)],
    [("21080", "SET/20 RED RETROSPOT PAPER NAPKINS", 0.85),
     ("21086", "SET/60 I LOVE LONDON CAKE CASES", 0.55),
     ("21094", "SET/6 RED SPOTTY PAPER PLATES", 0.85)],
]
N_CUSTOMERS = 150
FIRST_CUSTOMER = 10001
FIRST_INVOICE = 500001
YEAR_START = "2023-01-01"
N_DAYS = 365
P_MISSING_CUSTOMER = 0.08
P_CANCEL = 0.03
P_BAD_PRICE = 0.01


def _u(seed: int, *parts) -> F.Column:
    """Uniform [0, 1) from a 53-bit slice of xxhash64(seed, parts...)."""
    h = F.xxhash64(F.lit(seed), *parts)
    return F.shiftrightunsigned(h, 11).cast("double") / float(1 << 53)


def synthetic_retail(spark: SparkSession, num_records: int = 1500, seed: int = 42,
                     num_partitions: int | None = None) -> DataFrame:
    """Raw retail lines (InvoiceNo, StockCode, Description, Quantity,
    InvoiceDate, UnitPrice, CustomerID), exactly ``num_records`` rows."""
    bundles = F.array(*[F.array(*[F.struct(F.lit(c).alias("code"), F.lit(d).alias("desc"),
                                           F.lit(p).alias("price")) for c, d, p in b])
                        for b in BUNDLES])
    inv = spark.range(0, num_records, 1, num_partitions) if num_partitions else \
        spark.range(0, num_records)
    i = F.col("id")
    head = inv.select(
        i.alias("inv"),
        F.when(_u(seed, i, F.lit("c0")) > P_MISSING_CUSTOMER,
               (F.lit(FIRST_CUSTOMER) + F.floor(_u(seed, i, F.lit("c1")) * N_CUSTOMERS))
               .cast("string")).alias("CustomerID"),
        F.date_add(F.lit(YEAR_START).cast("date"),
                   F.floor(_u(seed, i, F.lit("d")) * N_DAYS).cast("int"))
        .cast("timestamp_ntz").alias("InvoiceDate"),
        bundles[F.floor(_u(seed, i, F.lit("b")) * len(BUNDLES)).cast("int")].alias("bundle"))
    head = head.withColumn(
        "size", (1 + F.floor(_u(seed, F.col("inv"), F.lit("n")) * F.size("bundle"))).cast("int"))
    # choose `size` items without replacement: order the bundle by a hash key
    keyed = F.transform("bundle", lambda it: F.struct(
        _u(seed, F.col("inv"), F.lit("o"), it["code"]).alias("k"), it.alias("it")))
    head = head.withColumn("picked", F.slice(F.array_sort(keyed), 1, F.col("size")))
    lines = head.select("inv", "CustomerID", "InvoiceDate", "size",
                        F.posexplode("picked").alias("line", "p"))
    u_c = _u(seed, F.col("inv"), F.col("line"), F.lit("x"))
    u_q = _u(seed, F.col("inv"), F.col("line"), F.lit("q"))
    cancel = u_c < P_CANCEL
    inv_no = (F.col("inv") + FIRST_INVOICE).cast("string")
    lines = lines.select(
        "inv", "line", "size",
        F.when(cancel, F.concat(F.lit("C"), inv_no)).otherwise(inv_no).alias("InvoiceNo"),
        F.col("p.it.code").alias("StockCode"), F.col("p.it.desc").alias("Description"),
        F.when(cancel, -(1 + F.floor(u_q * 4))).otherwise(1 + F.floor(u_q * 11))
        .cast("long").alias("Quantity"),
        "InvoiceDate", F.col("p.it.price").alias("UnitPrice"), "CustomerID")
    # global line position without a single-partition window: invoice ids are
    # contiguous per range partition, so position = lines before the partition
    # + lines before the invoice inside it
    tagged = cut_lineage(head.select("inv", "size").withColumn("_pid", F.spark_partition_id()))
    offs = tagged.groupBy("_pid").agg(F.sum("size").alias("_n")).withColumn(
        "_off", F.coalesce(F.sum("_n").over(
            Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inv_pos = tagged.withColumn(
        "_before", F.coalesce(F.sum("size").over(
            Window.partitionBy("_pid").orderBy("inv")
            .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).join(
        F.broadcast(offs.select("_pid", "_off")), "_pid").select(
        "inv", (F.col("_off") + F.col("_before")).alias("_start"))
    pos = F.col("_start") + F.col("line")
    out = lines.join(inv_pos, "inv").filter(pos < num_records)
    bad = _u(seed, pos, F.lit("price")) < P_BAD_PRICE
    return out.select("InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate",
                      F.when(bad, F.lit(-1.0)).otherwise(F.col("UnitPrice")).alias("UnitPrice"),
                      "CustomerID")
