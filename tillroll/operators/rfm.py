"""Recency / frequency / monetary features per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.session import cut_lineage

FEATURES = ["Recency", "Frequency", "Monetary"]


def rfm_raw(clean: DataFrame) -> DataFrame:
    """(CustomerID, Recency, Frequency, Monetary), Monetary > 0 only.

    The per-customer aggregate (last purchase, distinct invoices, spend) is
    written once: the lines are scanned once, and the snapshot (latest date + 1
    day) and everything built on the result read that customer-sized table.
    Recency counts whole 24-hour days, not calendar days. Frequency is a
    distinct count that Spark pre-aggregates on (customer, invoice) shuffled on
    both keys, so one heavy customer does not land in a single task. A customer
    without any readable date has no recency and is left out;
    ``undated_customers`` counts them.
    """
    per = _per_customer(clean)
    snap = per.select(F.max("_last") + F.expr("INTERVAL 1 DAY")).scalar()
    return (per.filter((F.col("Monetary") > 0) & F.col("_last").isNotNull())
               .select("CustomerID", F.timestamp_diff("DAY", F.col("_last"), snap).alias("Recency"),
                       "Frequency", "Monetary"))


def _per_customer(clean: DataFrame) -> DataFrame:
    return cut_lineage(clean.groupBy("CustomerID")
                       .agg(F.max("InvoiceDate").alias("_last"),
                            F.count_distinct("InvoiceNo").alias("Frequency"),
                            F.sum("TotalPrice").alias("Monetary")))


def undated_customers(clean: DataFrame) -> DataFrame:
    """One row: customers with spend but no readable date, which ``rfm_raw`` leaves out."""
    return _per_customer(clean).agg(
        F.count_if((F.col("Monetary") > 0) & F.col("_last").isNull()).alias("undated_customers"))


def rfm_scaled(raw_rfm: DataFrame, features=FEATURES) -> DataFrame:
    """log1p, then z-score with the population standard deviation.

    A feature with zero spread scales to 0. All means and deviations come
    from one aggregate over ``raw_rfm`` read as a single struct-valued scalar
    subquery (one job, six numbers).
    """
    logged = raw_rfm.select("CustomerID", *[F.log1p(F.col(c)).alias(c) for c in features])
    stats = logged.agg(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c)
                                  for c in features]).alias("st"))
    staged = logged.select("CustomerID", *features, stats.scalar().alias("_st"))
    out = []
    for c in features:
        m, sd = F.col("_st")[c]["m"], F.col("_st")[c]["s"]
        out.append(F.when(sd == 0, F.lit(0.0)).otherwise((F.col(c) - m) / sd).alias(c))
    return staged.select("CustomerID", *out)


def rfm_histogram(raw_rfm: DataFrame, bins: int = 20, features=FEATURES) -> DataFrame:
    """Equal-width histogram per feature: (feature, bin, bin_lo, bin_hi, n).

    Bounds come from a scalar subquery; each row is unpivoted to three
    (feature, value) rows and counted with map-side partial aggregation.
    """
    long = raw_rfm.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
        for c in features])).alias("fv")).select("fv.*")
    bounds = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    # bounds has one row per feature (three rows): a broadcast of fixed size
    j = long.join(F.broadcast(bounds), "feature")
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins),
                F.lit(bins - 1))).cast("int")
    return (j.withColumn("bin", b)
             .groupBy("feature", "bin", "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
             .select("feature", "bin",
                     (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
                     (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"), "n"))


def wcss_k1(scaled: DataFrame, features=FEATURES) -> DataFrame:
    """Total sum of squares about the mean (the elbow curve at k = 1)."""
    n = F.count(F.lit(1))
    parts = [F.sum(F.col(c) * F.col(c)) - n * F.avg(c) * F.avg(c) for c in features]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return scaled.agg(total.alias("wcss"), n.alias("n_points"))
