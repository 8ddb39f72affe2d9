"""Golden itemsets and rules (every split, two-item consequents included)."""

import math

import pytest

from tillroll.operators import mining, rules


@pytest.fixture
def items(spark):
    b = [("1", "a"), ("1", "b"), ("1", "c"), ("2", "a"), ("2", "b"), ("2", "c"),
         ("3", "a"), ("3", "b"), ("4", "c")]
    return spark.createDataFrame(b, "InvoiceNo string, item string")


def _sets(df):
    return {tuple(r["items"]): r["freq"] for r in df.collect()}


EXPECTED = {("a",): 3, ("b",): 3, ("c",): 3, ("a", "b"): 3, ("a", "c"): 2, ("b", "c"): 2,
            ("a", "b", "c"): 2}


def test_apriori_and_fpgrowth_agree(spark, items):
    from pyspark.sql import functions as F
    baskets = items.groupBy("InvoiceNo").agg(F.sort_array(F.collect_list("item")).alias("items"))
    assert _sets(mining.apriori_itemsets(items, 0.5)) == EXPECTED
    assert _sets(mining.fpgrowth_itemsets(baskets, 0.5)) == EXPECTED


def test_all_splits_and_metrics(spark, items):
    its = mining.apriori_itemsets(items, 0.5)
    r = {(tuple(x.antecedents), tuple(x.consequents)): x
         for x in rules.association_rules(its, "confidence", 0.1).collect()}
    assert len(r) == 12
    ab = r[(("a",), ("b",))]
    assert (ab.support, ab.confidence, ab.lift, ab.leverage) == (0.75, 1.0, 1.3333, 0.1875)
    assert math.isinf(ab.conviction)
    a_bc = r[(("a",), ("b", "c"))]
    assert (a_bc.support, a_bc.confidence, a_bc.lift, a_bc.leverage, a_bc.conviction) == \
        (0.5, 0.6667, 1.3333, 0.125, 1.5)
    c_ab = r[(("c",), ("a", "b"))]
    assert (c_ab.lift, c_ab.leverage, c_ab.conviction) == (0.8889, -0.0625, 0.75)
    ab_c = r[(("a", "b"), ("c",))]
    assert ab_c.rule == "a, b ➔ c"


def test_metric_selector(spark, items):
    its = mining.apriori_itemsets(items, 0.5)
    lifted = rules.association_rules(its, "lift", 1.0).collect()
    assert all(x.lift >= 1.0 for x in lifted) and len(lifted) == 6
    with pytest.raises(ValueError):
        rules.association_rules(its, "nonsense", 1.0)


def test_graph_degree(spark, items):
    its = mining.apriori_itemsets(items, 0.5)
    e = rules.rule_graph_edges(rules.association_rules(its, "confidence", 0.1), 15)
    nodes = {r.id: r.degree for r in rules.rule_graph_nodes(e).collect()}
    # a->b, b->a, a->c, c->a, a->"b, c", "b, c"->a
    assert nodes["a"] == 6 and nodes["b, c"] == 2


def _all_splits(table, metric, t):
    """Every split by bit masks, and its metric, from {items: support}."""
    out = {}
    for items, s in table.items():
        for mask in range(1, (1 << len(items)) - 1):
            a = tuple(x for i, x in enumerate(items) if mask >> i & 1)
            c = tuple(x for i, x in enumerate(items) if not mask >> i & 1)
            sa, sc = table[a], table[c]
            conf, lev = s / sa, s - sa * sc
            den = max(s * (1 - sa), sa * (sc - s))
            m = {"antecedent_support": sa, "consequent_support": sc, "support": s, "confidence": conf,
                 "lift": conf / sc, "leverage": lev, "zhangs_metric": lev / den if den else 0.0,
                 "conviction": math.inf if conf >= 1 else (1 - sc) / (1 - conf)}
            if m[metric] >= t:
                out[a, c] = m[metric]
    return out


def _closed_table(seed):
    """Supports of all itemsets of a random basket table."""
    import itertools
    import random
    rng = random.Random(seed)
    baskets = [frozenset(x for x in "abcde" if rng.random() < rng.choice([0.3, 0.9])) for _ in range(40)]
    table = {}
    for k in range(1, 6):
        for items in itertools.combinations("abcde", k):
            n = sum(set(items) <= b for b in baskets)
            if n >= 2:
                table[items] = n / 40
    return table


@pytest.mark.parametrize(("metric", "thresholds"), [
    ("confidence", (0.0, 0.8)), ("lift", (0.0, 1.1)), ("leverage", (-1.0, 0.05)),
    ("conviction", (-1.0, 1.5)), ("zhangs_metric", (-0.5, 0.2)), ("support", (0.2,)),
    ("antecedent_support", (0.6,)), ("consequent_support", (0.6,))])
def test_growth_loses_no_rule_of_any_metric(spark, metric, thresholds):
    table = _closed_table(3)
    its = spark.createDataFrame([(list(i), s) for i, s in table.items()], "items array<string>, support double")
    for t in thresholds:
        got = {(tuple(r.antecedents), tuple(r.consequents)): r[metric]
               for r in rules.association_rules(its, metric, t, round_metrics=False).collect()}
        want = _all_splits(table, metric, t)
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k]) for k in got)


@pytest.mark.parametrize("k", [25, 70])
def test_long_itemsets_cost_what_can_reach_the_threshold(spark, k):
    """Of k items three imply the others' support: 7 rules at confidence 0.9, not 2^k splits."""
    import itertools
    items = [f"i{j:03d}" for j in range(k)]
    free = [items[2], items[7], items[k - 1]]
    rows = [(items, 0.5)]
    for i in items:
        rest = [x for x in items if x != i]
        rows += [([i], 0.8), (rest, 0.52 if i in free else 0.9)]
    for n in (2, 3):
        for c in itertools.combinations(free, n):
            rows += [(sorted(c), 0.7), ([x for x in items if x not in c], 0.52 + 0.01 * n)]
    its = spark.createDataFrame(rows, "items array<string>, support double")
    got = rules.association_rules(its, "confidence", 0.9).where("size(antecedents) + size(consequents) = %d" % k)
    found = {tuple(r.consequents) for r in got.collect()}
    assert found == {c for n in (1, 2, 3) for c in itertools.combinations(sorted(free), n)}


def test_no_itemset_with_two_items_gives_no_rule(spark):
    its = spark.createDataFrame([(["a"], 1.0)], "items array<string>, support double")
    assert rules.association_rules(its).count() == 0
    assert rules.association_rules(its.where("support < 0")).count() == 0


def test_large_baskets_are_paired_in_blocks(spark, monkeypatch):
    """One basket of 300 items beside small ones: every pair once, whatever block its items are in."""
    monkeypatch.setattr(mining, "BASKET_BLOCK", 20)
    rows = [("big", f"i{j:03d}") for j in range(300)] + [("s1", "i001"), ("s1", "i007"), ("s2", "i001"), ("s2", "i007")]
    df = spark.createDataFrame(rows, "InvoiceNo string, item string")
    got = {(r.a, r.b): r.freq for r in mining.pair_counts(df).collect()}
    assert len(got) == 300 * 299 // 2 and all(a < b for a, b in got)
    assert got["i001", "i007"] == 3 and sum(got.values()) == len(got) + 2
    assert {tuple(r["items"]): r.freq for r in mining.apriori_itemsets(df, 1.0).collect()} == {
        ("i001",): 3, ("i007",): 3, ("i001", "i007"): 3}
