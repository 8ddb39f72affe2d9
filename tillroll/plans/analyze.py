"""One-call analysis: clean, RFM, K-Means, metrics, baskets, FP-Growth, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillroll.operators import baskets, clean, evaluate, kmeans, mining, rfm, rules
from tillroll.session import cut_lineage


def analyze(raw: DataFrame, n_clusters: int = 3, min_support: float = 0.03,
            min_confidence: float = 0.2, top_n: int = 5) -> DataFrame:
    """One-row summary of a raw retail table.

    ``status``, ``cleaned_rows``, ``metrics`` (the K-Means metric record),
    ``mined_rules_count`` and ``top_rules`` (first ``top_n`` rules by lift,
    then confidence, support and rule text). The cleaned lines are
    checkpointed once because both branches (customers and baskets) read them.
    """
    lines = cut_lineage(clean.clean_lines(raw))
    raw_rfm = rfm.rfm_raw(lines)
    scaled = cut_lineage(rfm.rfm_scaled(raw_rfm))
    km = kmeans.kmeans(scaled, k=n_clusters)
    metrics = evaluate.cluster_metrics(scaled.join(km.labels, "CustomerID"))
    itemsets = mining.fpgrowth_itemsets(baskets.basket_arrays(lines), min_support)
    rl = cut_lineage(rules.association_rules(itemsets, "confidence", min_confidence))
    # a collected list has no order of its own: the position is collected with it and sorted on (top_n rows)
    top = rl.orderBy(*rules.lift_order()).limit(top_n).select(
        F.row_number().over(Window.orderBy(*rules.lift_order())).alias("position"),
        "rule", "support", "confidence", "lift")
    top_arr = top.agg(F.transform(F.sort_array(F.collect_list(F.struct(*top.columns))),
                                  lambda r: r.dropFields("position"))).scalar()
    m = metrics.select(F.struct(*metrics.columns).alias("m")).scalar()
    return lines.sparkSession.range(1).select(
        F.lit("success").alias("status"),
        lines.select(F.count(F.lit(1))).scalar().alias("cleaned_rows"),
        m.alias("metrics"),
        rl.select(F.count(F.lit(1))).scalar().alias("mined_rules_count"),
        top_arr.alias("top_rules"))
