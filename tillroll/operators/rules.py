"""Association rules from frequent itemsets: every antecedent/consequent split that can reach the threshold.

MLlib's ``associationRules`` only yields one-item consequents; here every
non-empty proper subset of an itemset may be a consequent, with the metric set
of the usual rule-mining libraries. Consequents grow level by level: of one
itemset, a larger consequent has a smaller antecedent and so a lower
confidence, and a split that fails rules out all larger ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.session import cut_lineage

METRICS = ["antecedent_support", "consequent_support", "support", "confidence", "lift",
           "leverage", "conviction", "zhangs_metric"]
ROUNDED = ["support", "confidence", "lift", "leverage", "conviction"]


#: Relative slack of the bounds below, so that rounding never rules out a rule that the metric itself keeps.
SLACK = 1e-9


def _lookup(itemsets: DataFrame, name: str) -> DataFrame:
    return itemsets.select(F.col("items").alias(name), F.col("support").alias(f"{name}_s"))


def rule_metrics(s: Column, sa: Column, sc: Column) -> dict[str, Column]:
    conf = s / sa
    lev = s - sa * sc
    den = F.greatest(s * (1 - sa), sa * (sc - s))
    return {
        "confidence": conf,
        "lift": conf / sc,
        "leverage": lev,
        "conviction": F.when(conf >= 1.0, F.lit(float("inf"))).otherwise((1 - sc) / (1 - conf)),
        "zhangs_metric": F.when(den == 0, F.lit(0.0)).otherwise(lev / den),
    }


def _may_reach(metric: str, t: float, s: Column, sa: Column, sc: Column) -> Column:
    """Whether a split, or one with a larger consequent, may reach ``metric >= t``.

    Splits of the itemset with larger consequents have a lower confidence and a
    consequent support of at least ``s``, from which a least confidence
    follows for each metric. Antecedent support grows with the consequent:
    there the antecedent is grown instead, and must itself reach ``t``.
    """
    conf = s / sa
    if metric == "confidence":
        return conf >= t * (1 - SLACK)
    if metric == "lift":            # conf / sc <= conf / s
        return conf >= t * s * (1 - SLACK)
    if metric == "leverage":        # s - sa * sc <= s - sa * s
        return s - sa * s >= t - SLACK
    if metric == "conviction":      # (1 - sc) / (1 - conf) <= (1 - s) / (1 - conf)
        return F.lit(True) if t <= 0 else (1 - conf) * t <= (1 - s) * (1 + SLACK) + SLACK
    if metric == "zhangs_metric":   # positive only if conf > sc >= s
        return F.lit(True) if t <= 0 else conf >= s * (1 - SLACK)
    if metric == "support":         # the same for all splits
        return s >= t
    if metric == "consequent_support":
        return sc >= t
    return sa >= t                  # antecedent_support, of the grown antecedent


def _splits(itemsets: DataFrame, metric: str, t: float) -> DataFrame:
    """(support, antecedents, antecedents_s, consequents, consequents_s) of all splits that may reach the threshold.

    A level holds the subsets of one size that are grown, each with its
    itemset's id; two that share all but their last item make a candidate of
    the next. A level is written once: it is read as rules, and twice to grow.
    """
    grown, rest = (("antecedents", "consequents") if metric == "antecedent_support"
                   else ("consequents", "antecedents"))
    table = cut_lineage(itemsets.select("items", "support", F.monotonically_increasing_id().alias("id")))
    size = table.agg(F.max(F.size("items"))).first()[0] or 0
    level = table.where(F.size("items") >= 2).select(
        "id", "items", "support", F.explode("items").alias("last")).select(
        "id", "items", "support", F.array("last").alias(grown))
    found: list[DataFrame] = []
    while True:
        splits = (level.withColumn(rest, F.array_except("items", grown)).where(F.size(rest) >= 1)
                  .join(_lookup(table, rest), rest).join(_lookup(table, grown), grown))
        keep = _may_reach(metric, t, F.col("support"), F.col("antecedents_s"), F.col("consequents_s"))
        kept = cut_lineage(splits.where(keep))
        found.append(kept)
        if len(found) + 1 >= size or kept.isEmpty():
            break
        most = F.lit(len(found) - 1)
        left = kept.select("id", "items", "support", grown, F.slice(grown, F.lit(1), most).alias("head"))
        right = kept.select("id", F.slice(grown, F.lit(1), most).alias("head"), F.element_at(grown, -1).alias("last"))
        level = (left.join(right, ["id", "head"]).where(F.element_at(grown, -1) < F.col("last"))
                 .select("id", "items", "support", F.concat(grown, F.array("last")).alias(grown)))
    return reduce(DataFrame.unionByName, found)


def association_rules(itemsets: DataFrame, metric: str = "confidence",
                      min_threshold: float = 0.2, round_metrics: bool = True) -> DataFrame:
    """Rules ``antecedents -> consequents`` with support, confidence, lift,
    leverage, conviction and Zhang's metric, kept where ``metric >=
    min_threshold`` (unrounded), then rounded to 4 dp on the five displayed
    metrics, plus the joined-text columns ``antecedents_str``,
    ``consequents_str`` and ``rule``.

    ``itemsets`` must hold every subset of its itemsets, as the miners'
    results do; a split with a side that is missing gives no rule, nor do the
    splits grown from it. Itemsets may have any number of items: the work
    follows the splits that can reach the threshold, not all 2^k - 2.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; choose one of {METRICS}")
    j = _splits(itemsets, metric, min_threshold)
    sa, sc, s = F.col("antecedents_s"), F.col("consequents_s"), F.col("support")
    m = rule_metrics(s, sa, sc)
    rules = j.select("antecedents", "consequents", sa.alias("antecedent_support"),
                     sc.alias("consequent_support"), s.alias("support"),
                     *[v.alias(k) for k, v in m.items()])
    rules = rules.filter(F.col(metric) >= min_threshold)
    if round_metrics:
        rules = rules.withColumns({c: F.round(c, 4) for c in ROUNDED})
    a_str = F.array_join("antecedents", ", ")
    c_str = F.array_join("consequents", ", ")
    return rules.withColumns({
        "antecedents_str": a_str,
        "consequents_str": c_str,
        "rule": F.concat(a_str, F.lit(" ➔ "), c_str),
    })


def lift_order() -> list[Column]:
    """Deterministic top-k order: lift, confidence, support descending, rule."""
    return [F.col("lift").desc(), F.col("confidence").desc(), F.col("support").desc(),
            F.col("rule").asc()]


def filter_by_lift(rules: DataFrame, min_lift: float = 1.0) -> DataFrame:
    """Rules whose (rounded) lift reaches ``min_lift``."""
    return rules.filter(F.col("lift") >= min_lift)


def rules_table(rules: DataFrame) -> DataFrame:
    """Display projection, by lift descending."""
    return rules.select("rule", "antecedents_str", "consequents_str", "support", "confidence",
                        "lift").orderBy(*lift_order())


def rule_graph_edges(rules: DataFrame, top_n: int = 15) -> DataFrame:
    """Directed edges of the top-n rules by lift: (src, dst, weight=lift).

    Each rule gives a distinct (antecedent text, consequent text) pair, so the
    de-duplication keeps every edge; it runs on at most ``top_n`` rows.
    """
    top = rules.orderBy(*lift_order()).limit(top_n)
    return (top.select(F.col("antecedents_str").alias("src"),
                       F.col("consequents_str").alias("dst"), F.col("lift").alias("weight"))
               .dropDuplicates(["src", "dst"]))


def rule_graph_nodes(edges: DataFrame) -> DataFrame:
    """Nodes of the rule graph with degree = in-edges + out-edges, and the text shown over a node."""
    ends = edges.select(F.col("src").alias("id")).unionAll(edges.select(F.col("dst").alias("id")))
    return (ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
            .withColumn("hover", F.format_string("Item: %s | Connections: %d", "id", "degree")))
