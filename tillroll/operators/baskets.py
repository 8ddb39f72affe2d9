"""Invoice baskets in long, array and (on request) wide form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.functions.ranking import dense_index


def basket_long(clean: DataFrame, item_col: str = "Description") -> DataFrame:
    """(InvoiceNo, item, Quantity): quantity summed per invoice and item."""
    return (clean.groupBy("InvoiceNo", F.col(item_col).alias("item"))
                 .agg(F.sum("Quantity").alias("Quantity")))


def basket_items(clean: DataFrame, item_col: str = "Description") -> DataFrame:
    """Distinct (InvoiceNo, item) pairs with a positive summed quantity."""
    return basket_long(clean, item_col).filter(F.col("Quantity") > 0).select("InvoiceNo", "item")


def basket_arrays(clean: DataFrame, item_col: str = "Description") -> DataFrame:
    """(InvoiceNo, items): each basket as a sorted array of distinct items.

    The (invoice, item) de-duplication runs first, shuffled on both keys, so a
    huge invoice is spread before the per-invoice collect; the collected array
    is bounded by the item vocabulary.
    """
    return (basket_items(clean, item_col)
            .groupBy("InvoiceNo")
            .agg(F.sort_array(F.collect_list("item")).alias("items")))


def item_index(clean: DataFrame, item_col: str = "Description") -> DataFrame:
    """(item, item_no): the items that occur, numbered from 0 in their order by a range-partitioned rank."""
    items = clean.select(F.col(item_col).alias("item")).where("item is not null")
    return dense_index(items, ["item"], "item_no")


def basket_vectors(clean: DataFrame, item_col: str = "Description") -> DataFrame:
    """(InvoiceNo, n_items, item_nos): the wide boolean matrix as one sparse vector per invoice.

    ``item_nos`` are the true columns in order, by ``item_index``; an invoice
    without a positive quantity has none. The vocabulary stays distributed, so
    it may have any size; a basket is de-duplicated on both keys before its
    numbers are collected.
    """
    long = basket_long(clean, item_col)
    numbered = long.join(item_index(clean, item_col), "item", "left")
    sold = F.when((F.col("Quantity") > 0) & F.col("item_no").isNotNull(), F.col("item_no"))
    return (numbered.groupBy("InvoiceNo").agg(F.sort_array(F.collect_list(sold)).alias("item_nos"))
            .select("InvoiceNo", F.size("item_nos").alias("n_items"), "item_nos"))


def basket_matrix(clean: DataFrame, items: list[str], item_col: str = "Description") -> DataFrame:
    """Wide boolean matrix of the named items: one row per invoice, one column per item.

    A wide table needs its column names at plan time, so they are the
    caller's; ``basket_vectors`` is the form for a whole vocabulary. An item
    that is called like the key column gets the suffix ``_item``.
    """
    long = basket_long(clean, item_col)
    names = [f"{i}_item" if i == "InvoiceNo" else i for i in items]
    return long.groupBy("InvoiceNo").agg(F.count(F.lit(1)).alias("_any"), *[
        (F.coalesce(F.sum(F.when(F.col("item") == F.lit(i), F.col("Quantity"))), F.lit(0.0)) > 0).alias(n)
        for i, n in zip(items, names, strict=True)]).drop("_any")


def top_products(clean: DataFrame, n: int = 10, item_col: str = "Description") -> DataFrame:
    """Top-n items by summed quantity (ties by item name).

    Partial sums per item, then ``TakeOrderedAndProject``: each partition keeps
    its n best, the driver merges n × partitions rows.
    """
    return (clean.groupBy(F.col(item_col).alias("Description"))
                 .agg(F.sum("Quantity").alias("Quantity"))
                 .orderBy(F.col("Quantity").desc(), F.col("Description").asc())
                 .limit(n))


def basket_count(baskets: DataFrame):
    """Scalar subquery: number of baskets."""
    return baskets.select(F.count(F.lit(1))).scalar()


def item_support(items: DataFrame) -> DataFrame:
    """(item, n_baskets, support) over distinct (InvoiceNo, item) pairs."""
    n = items.select(F.count_distinct("InvoiceNo")).scalar()
    return (items.groupBy("item").agg(F.count(F.lit(1)).alias("n_baskets"))
                 .withColumn("support", F.col("n_baskets") / n))
