"""Frequent itemset mining: parallel FP-Growth (MLlib) and level-wise Apriori.

Both return ``(items array<string> sorted, freq long, support double)`` with the
same threshold rule: an itemset is frequent when ``freq >= ceil(min_support*N)``
(N = number of baskets, computed in double arithmetic as Spark's FP-Growth does).
"""

from __future__ import annotations

import math
import time

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.session import cut_lineage


#: Items of one basket that are paired within one join key.
BASKET_BLOCK = 1024


def min_count(min_support: float, n_baskets: int) -> int:
    return int(math.ceil(min_support * n_baskets))


def _with_support(itemsets: DataFrame, n_baskets: int) -> DataFrame:
    return itemsets.withColumn("support", F.col("freq") / F.lit(float(n_baskets)))


def fpgrowth_itemsets(baskets: DataFrame, min_support: float = 0.02,
                      num_partitions: int | None = None) -> DataFrame:
    """FP-Growth over ``(InvoiceNo, items)`` baskets (items distinct).

    MLlib's parallel FP-Growth: item counts with map-side combine, then each
    basket is sent once per item group and mined in local FP-trees. Items are
    returned sorted so itemsets join and compare as keys.
    """
    baskets = cut_lineage(baskets.select("items"))   # counted, then mined
    n = baskets.count()
    if n == 0:
        return baskets.sparkSession.createDataFrame(
            [], "items array<string>, freq long, support double")
    fp = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=1.0)
    if num_partitions:
        fp.setNumPartitions(num_partitions)
    model = fp.fit(baskets)
    # the itemset table is re-read by rule generation: materialise it once
    out = cut_lineage(model.freqItemsets.select(F.sort_array("items").alias("items"), "freq"))
    return _with_support(out, n)


def _prune_candidates(cands: DataFrame, level: DataFrame, k: int) -> DataFrame:
    """Keep (k+1)-candidates whose every k-subset is frequent (downward closure)."""
    subsets = cands.select(
        "items",
        F.explode(F.sequence(F.lit(0), F.lit(k))).alias("drop_at")).select(
        "items",
        F.expr("filter(items, (x, i) -> i != drop_at)").alias("sub"))
    hits = subsets.join(level.select(F.col("items").alias("sub")), "sub", "left_semi")
    return (hits.groupBy("items").agg(F.count(F.lit(1)).alias("n_sub"))
                .filter(F.col("n_sub") == k + 1).select("items"))


def _numbered(level: DataFrame) -> DataFrame:
    """A level's itemsets with an id each, written once (so the ids stay)."""
    return cut_lineage(level.withColumn("id", F.monotonically_increasing_id()))


def _pairs(items: DataFrame, key: str) -> DataFrame:
    """(InvoiceNo, a, b) of every two items of a basket in order of their names, one row per pair.

    A basket of more than ``BASKET_BLOCK`` items is dealt to blocks, and every
    pair of its blocks is a join key of its own: 100,000 items of one invoice
    meet in thousands of groups of a bounded size, not in one task. The large
    baskets are listed first (usually none), so the others join as they are.
    """
    large = cut_lineage(items.groupBy("InvoiceNo").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BASKET_BLOCK)
                        .select("InvoiceNo", F.ceil(F.col("_n") / BASKET_BLOCK).cast("int").alias("_nb")))
    rows = items.join(large, "InvoiceNo", "left").withColumn("_nb", F.coalesce("_nb", F.lit(1)))
    own = F.pmod(F.xxhash64(key), F.col("_nb")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))
    left = rows.select("InvoiceNo", F.col(key).alias("a"), F.col("item").alias("ia"), own.alias("_l"), every.alias("_r"))
    right = rows.select("InvoiceNo", F.col(key).alias("b"), F.col("item").alias("ib"), own.alias("_r"), every.alias("_l"))
    return left.join(right, ["InvoiceNo", "_l", "_r"]).where("ia < ib").select("InvoiceNo", "a", "b")


def apriori_itemsets(items: DataFrame, min_support: float = 0.02,
                     max_len: int | None = None) -> DataFrame:
    """Level-wise Apriori over distinct ``(InvoiceNo, item)`` pairs.

    Level 1 counts items; level 2 counts the pairs of a basket's frequent items
    straight from a self-join with partial aggregation (pairs are not written,
    and one large basket is dealt to many join keys, see ``_pairs``). From
    there an occurrence is a row of two longs, (basket, itemset): level k + 1
    meets the pruned candidates of its itemset and the basket's items, so
    exactly the (basket, candidate) containments are produced, written once,
    counted, and used for the next level. Join strategies are left to Spark.
    The loop stops at the first empty level.
    """
    spark = items.sparkSession
    items = cut_lineage(items.select("InvoiceNo", "item"))   # read at every level
    n = items.select("InvoiceNo").distinct().count()
    if n == 0:
        return spark.createDataFrame([], "items array<string>, freq long, support double")
    mc = min_count(min_support, n)

    l1 = _numbered(items.groupBy("item").agg(F.count(F.lit(1)).alias("freq")).filter(F.col("freq") >= mc)
                   .select(F.array("item").alias("items"), "freq"))
    levels = [l1]
    if max_len == 1 or l1.isEmpty():
        return _with_support(l1.drop("id"), n)
    # an infrequent item is in no itemset
    known = cut_lineage(items.join(l1.select(F.col("items")[0].alias("item"), "id"), "item"))
    pairs = _pairs(known, "id")
    names = l1.select("id", F.col("items")[0].alias("name"))
    counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("freq")).filter(F.col("freq") >= mc)
    l2 = _numbered(counted.join(names.select(F.col("id").alias("a"), F.col("name").alias("na")), "a")
                   .join(names.select(F.col("id").alias("b"), F.col("name").alias("nb")), "b")
                   .select(F.array("na", "nb").alias("items"), "freq", "a", "b"))
    occ = pairs.join(l2.select("a", "b", "id"), ["a", "b"]).select("InvoiceNo", "id")
    level, k = l2.drop("a", "b"), 2
    while not level.isEmpty():
        levels.append(level)
        if max_len is not None and k >= max_len:
            break
        # candidates: frequent k-itemsets that share their first k-1 items
        a = level.select(F.slice("items", 1, k - 1).alias("pre"), F.col("items").alias("ia"))
        b = level.select(F.slice("items", 1, k - 1).alias("pre"), F.element_at("items", -1).alias("last_b"))
        cands = (a.join(b, "pre").filter(F.element_at("ia", -1) < F.col("last_b"))
                 .select(F.concat("ia", F.array("last_b")).alias("items")))
        cands = _numbered(_prune_candidates(cands, level, k))
        if cands.isEmpty():
            break
        extend = (cands.select(F.slice("items", 1, k).alias("items"), F.element_at("items", -1).alias("item"),
                               F.col("id").alias("new_id"))
                  .join(level.select("items", "id"), "items").select("id", "item", "new_id"))
        occ = cut_lineage(occ.join(extend, "id").join(known.select("InvoiceNo", "item"), ["InvoiceNo", "item"])
                          .select("InvoiceNo", F.col("new_id").alias("id")))
        counts = occ.groupBy("id").agg(F.count(F.lit(1)).alias("freq")).filter(F.col("freq") >= mc)
        level = cut_lineage(counts.join(cands, "id").select("items", "freq", "id"))
        k += 1
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    return _with_support(out.drop("id"), n)


def pair_counts(items: DataFrame) -> DataFrame:
    """Co-occurrence count of every item pair that appears in some basket
    (the level-2 support table before the threshold)."""
    named = cut_lineage(items.select("InvoiceNo", "item", F.col("item").alias("name")))
    return _pairs(named, "name").groupBy("a", "b").agg(F.count(F.lit(1)).alias("freq"))


def compare_miners(items: DataFrame, baskets: DataFrame, min_support: float = 0.02) -> DataFrame:
    """Wall time and itemset count of each miner, and the speed ratio.

    Each miner's full result is forced with the no-op sink so the timing covers
    the whole plan without collecting it.
    """
    spark = items.sparkSession
    t0 = time.perf_counter()
    ap = apriori_itemsets(items, min_support)
    ap.write.format("noop").mode("overwrite").save()
    t1 = time.perf_counter()
    fp = fpgrowth_itemsets(baskets, min_support)
    fp.write.format("noop").mode("overwrite").save()
    t2 = time.perf_counter()
    ta, tf = round(t1 - t0, 5), round(t2 - t1, 5)
    return spark.createDataFrame(
        [(ta, tf, ap.count(), fp.count(), round(ta / max(tf, 1e-6), 2))],
        "apriori_time_sec double, fpgrowth_time_sec double, apriori_itemset_count long, "
        "fpgrowth_itemset_count long, speedup_factor double")


def miner_timings(comparison: DataFrame) -> DataFrame:
    """Long form of the comparison: (algorithm, measure, value), two measures per miner."""
    return comparison.select(F.expr(
        "stack(4, 'Apriori', 'time_sec', apriori_time_sec, 'FP-Growth', 'time_sec', fpgrowth_time_sec, "
        "'Apriori', 'itemsets', double(apriori_itemset_count), 'FP-Growth', 'itemsets', double(fpgrowth_itemset_count)) "
        "as (algorithm, measure, value)"))
