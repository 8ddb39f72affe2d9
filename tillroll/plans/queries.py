"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the driver tables through the retail view and runs over the
whole tables. Doubles are rounded in the final projection (4 dp for ratios and
features, 2 dp for money) so that results compare exactly with the oracle
engine regardless of summation order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators import baskets, clean, rfm
from tillroll.sources.tables import retail_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__.removeprefix("q_")] = fn
    return fn


def _clean(spark, sf_dir):
    return clean.clean_lines(retail_lines(spark, sf_dir))


def _rfm(spark, sf_dir):
    return rfm.rfm_raw(_clean(spark, sf_dir))


def _scaled(spark, sf_dir):
    return rfm.rfm_scaled(_rfm(spark, sf_dir))


def r4(*cols):
    return [F.round(F.col(c), 4).alias(c) for c in cols]


@query
def q_clean_lines(spark, sf_dir):
    c = _clean(spark, sf_dir)
    return c.select("InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate",
                    "UnitPrice", "CustomerID", "TotalPrice")


@query
def q_clean_preview(spark, sf_dir):
    return (q_clean_lines(spark, sf_dir)
            .orderBy("InvoiceNo", "StockCode", "InvoiceDate", "Quantity", "UnitPrice").limit(5))


@query
def q_clean_audit(spark, sf_dir):
    return clean.clean_audit(retail_lines(spark, sf_dir))


@query
def q_rfm_raw(spark, sf_dir):
    return _rfm(spark, sf_dir).select("CustomerID", "Recency", "Frequency",
                                      F.round("Monetary", 2).alias("Monetary"))


@query
def q_rfm_scaled(spark, sf_dir):
    return _scaled(spark, sf_dir).select("CustomerID", *r4(*rfm.FEATURES))


@query
def q_wcss_k1(spark, sf_dir):
    w = rfm.wcss_k1(_scaled(spark, sf_dir))
    return w.select(F.round("wcss", 4).alias("wcss"), "n_points")


@query
def q_rfm_histogram(spark, sf_dir):
    h = rfm.rfm_histogram(_rfm(spark, sf_dir), bins=20)
    return h.select("feature", "bin", *r4("bin_lo", "bin_hi"), "n")


@query
def q_basket_long(spark, sf_dir):
    return baskets.basket_long(_clean(spark, sf_dir))


@query
def q_basket_arrays(spark, sf_dir):
    b = baskets.basket_arrays(_clean(spark, sf_dir))
    return b.select("InvoiceNo", F.array_join("items", ", ").alias("items_str"),
                    F.size("items").alias("n_items"))


@query
def q_top_products(spark, sf_dir):
    return baskets.top_products(_clean(spark, sf_dir), n=10)


@query
def q_item_support(spark, sf_dir):
    s = baskets.item_support(baskets.basket_items(_clean(spark, sf_dir)))
    return s.select("item", "n_baskets", F.round("support", 6).alias("support"))


# ---- itemsets and rules -----------------------------------------------------
from tillroll.operators import mining, rules as rl  # noqa: E402

MIN_SUPPORT = 0.03     # interactive and API default
MIN_CONFIDENCE = 0.2   # interactive default
MIN_LIFT = 0.9         # slider value; lifts in the driver tables sit just under 1
RULE_COLS = ["antecedents_str", "consequents_str", "rule", "antecedent_support",
             "consequent_support", "support", "confidence", "lift", "leverage", "conviction",
             "zhangs_metric"]


def _items(spark, sf_dir):
    return baskets.basket_items(_clean(spark, sf_dir))


def _fp_itemsets(spark, sf_dir, min_support=MIN_SUPPORT):
    return mining.fpgrowth_itemsets(baskets.basket_arrays(_clean(spark, sf_dir)), min_support)


def _rules(spark, sf_dir, metric="confidence", threshold=MIN_CONFIDENCE):
    return rl.association_rules(_fp_itemsets(spark, sf_dir), metric, threshold)


def _itemset_view(df):
    return df.select(F.array_join("items", ", ").alias("items_str"),
                     F.size("items").alias("n_items"), "freq", "support")


@query
def q_frequent_itemsets(spark, sf_dir):
    return _itemset_view(_fp_itemsets(spark, sf_dir))


@query
def q_apriori_itemsets(spark, sf_dir):
    return _itemset_view(mining.apriori_itemsets(_items(spark, sf_dir), MIN_SUPPORT))


@query
def q_itemset_pairs(spark, sf_dir):
    return mining.pair_counts(_items(spark, sf_dir))


@query
def q_itemset_counts(spark, sf_dir):
    ap = mining.apriori_itemsets(_items(spark, sf_dir), MIN_SUPPORT)
    fp = _fp_itemsets(spark, sf_dir)
    return ap.agg(F.count(F.lit(1)).alias("apriori_itemset_count"),
                  fp.select(F.count(F.lit(1))).scalar().alias("fpgrowth_itemset_count"))


@query
def q_association_rules(spark, sf_dir):
    # confidence 0.1 keeps the two-item consequents in play
    return _rules(spark, sf_dir, "confidence", 0.1).select(*RULE_COLS)


@query
def q_rules_by_metric_lift(spark, sf_dir):
    return _rules(spark, sf_dir, "lift", 0.95).select(*RULE_COLS)


@query
def q_rules_by_metric_support(spark, sf_dir):
    return _rules(spark, sf_dir, "support", 0.05).select(*RULE_COLS)


def _active_rules(spark, sf_dir):
    return rl.filter_by_lift(_rules(spark, sf_dir), MIN_LIFT)


@query
def q_rules_by_lift(spark, sf_dir):
    return rl.rules_table(_active_rules(spark, sf_dir))


@query
def q_rules_scatter(spark, sf_dir):
    return _active_rules(spark, sf_dir).select("support", "confidence", "lift", "rule")


@query
def q_rule_graph_edges(spark, sf_dir):
    return rl.rule_graph_edges(_active_rules(spark, sf_dir), top_n=15)


@query
def q_rule_graph_nodes(spark, sf_dir):
    return rl.rule_graph_nodes(rl.rule_graph_edges(_active_rules(spark, sf_dir), top_n=15))


# ---- evaluation on deterministic labels (customer market segment) ---------
from tillroll.functions.ranking import dense_index  # noqa: E402
from tillroll.operators import evaluate as ev  # noqa: E402
from tillroll.sources.tables import customer_segments  # noqa: E402


def _segment_labels(spark, sf_dir, rfm_df):
    """(CustomerID, Cluster): the customer's market segment, numbered by name."""
    seg = customer_segments(spark, sf_dir)
    idx = dense_index(seg, ["segment"], "Cluster")
    return (rfm_df.select("CustomerID").join(seg, "CustomerID").join(idx, "segment")
                  .select("CustomerID", F.col("Cluster").cast("int").alias("Cluster")))


def _segment_points(spark, sf_dir):
    raw = _rfm(spark, sf_dir)
    scaled = rfm.rfm_scaled(raw)
    return scaled.join(_segment_labels(spark, sf_dir, raw), "CustomerID")


@query
def q_silhouette_exact(spark, sf_dir):
    return ev.silhouette_exact(_segment_points(spark, sf_dir)).select(
        F.round("silhouette_score", 4).alias("silhouette_score"))


@query
def q_davies_bouldin(spark, sf_dir):
    return ev.davies_bouldin(_segment_points(spark, sf_dir)).select(
        F.round("davies_bouldin_index", 4).alias("davies_bouldin_index"))


@query
def q_cluster_metrics(spark, sf_dir):
    return ev.cluster_metrics(_segment_points(spark, sf_dir))


@query
def q_cluster_profiles(spark, sf_dir):
    raw = _rfm(spark, sf_dir)
    return ev.cluster_profiles(raw, _segment_labels(spark, sf_dir, raw))


@query
def q_cluster_points(spark, sf_dir):
    raw = _rfm(spark, sf_dir)
    pts = ev.cluster_points(rfm.rfm_scaled(raw), _segment_labels(spark, sf_dir, raw))
    return pts.select("CustomerID", *r4(*rfm.FEATURES), "Cluster", "ClusterLabel")


# ---- density clustering -------------------------------------------------
from tillroll.operators import dbscan as db  # noqa: E402

DBSCAN_EPS = 0.5        # reference default
DBSCAN_MIN_SAMPLES = 5  # reference default


@query
def q_eps_neighbors(spark, sf_dir):
    return db.neighbour_counts(_scaled(spark, sf_dir), DBSCAN_EPS)


@query
def q_dbscan_labels(spark, sf_dir):
    return db.dbscan(_scaled(spark, sf_dir), DBSCAN_EPS, DBSCAN_MIN_SAMPLES)


# ---- K-Means ------------------------------------------------------------
from tillroll.operators import kmeans as km  # noqa: E402

KMEANS_K = 3        # reference default
ELBOW_MAX_K = 10    # reference default


@query
def q_kmeans_labels(spark, sf_dir):
    return km.kmeans(_scaled(spark, sf_dir), k=KMEANS_K).labels


@query
def q_kmeans_centroids(spark, sf_dir):
    c = km.kmeans(_scaled(spark, sf_dir), k=KMEANS_K).centroids
    return c.select("Cluster", "name", *r4(*rfm.FEATURES))


@query
def q_elbow_curve(spark, sf_dir):
    return km.elbow_curve(_scaled(spark, sf_dir), max_k=ELBOW_MAX_K).select(
        "k", F.round("wcss", 4).alias("wcss"))


@query
def q_kmeans_assign(spark, sf_dir):
    pts = _segment_points(spark, sf_dir)
    cents = pts.groupBy("Cluster").agg(*[F.avg(c).alias(c) for c in rfm.FEATURES])
    a = km.assign_nearest(pts, cents)
    return a.select("CustomerID", F.col("Cluster").cast("int").alias("Cluster"),
                    F.round("distance", 4).alias("distance"))


# ---- payload, personas, reports, analyze ------------------------------------
from tillroll.operators import report as rp  # noqa: E402
from tillroll.plans.analyze import analyze  # noqa: E402


def _segment_profile(spark, sf_dir):
    raw = _rfm(spark, sf_dir)
    return ev.cluster_profiles(raw, _segment_labels(spark, sf_dir, raw))


@query
def q_cluster_personas(spark, sf_dir):
    return rp.cluster_personas(_segment_profile(spark, sf_dir)).drop("description")


@query
def q_insight_payload(spark, sf_dir):
    """The payload flattened to rows: one per segment, one per top rule."""
    seg = rp.payload_segments(_segment_profile(spark, sf_dir))
    rules_ = rp.payload_rules(_rules(spark, sf_dir), 10)
    a = seg.select(F.lit("segment").alias("section"), F.col("cluster_id").cast("long").alias("position"),
                   "cluster_id", "recency_days_avg", "frequency_invoices_avg", "monetary_spend_avg",
                   "customer_count")
    b = rules_.select(F.lit("rule").alias("section"), F.col("position").cast("long"),
                      "antecedent_items", "consequent_items", "support", "confidence", "lift")
    return a.unionByName(b, allowMissingColumns=True)


@query
def q_insight_payload_json(spark, sf_dir):
    return rp.insight_payload(_segment_profile(spark, sf_dir), _rules(spark, sf_dir))


@query
def q_report_rules(spark, sf_dir):
    return rp.report_rules(rp.payload_rules(_rules(spark, sf_dir), 10), 5)


@query
def q_offline_report(spark, sf_dir):
    return rp.offline_report(_segment_profile(spark, sf_dir), _rules(spark, sf_dir))


@query
def q_offline_report_json(spark, sf_dir):
    """The report made from the JSON payload instead of the tables."""
    return rp.offline_report_json(rp.insight_payload(_segment_profile(spark, sf_dir), _rules(spark, sf_dir)))


@query
def q_insight_payload_parsed(spark, sf_dir):
    """The JSON payload read back into rows."""
    seg, rules_ = rp.payload_frames(rp.insight_payload(_segment_profile(spark, sf_dir), _rules(spark, sf_dir)))
    a = seg.select(F.lit("segment").alias("section"), F.col("cluster_id").cast("long").alias("position"), *seg.columns)
    b = rules_.select(F.lit("rule").alias("section"), F.col("position").cast("long").alias("position"),
                      *[c for c in rules_.columns if c != "position"])
    return a.unionByName(b, allowMissingColumns=True)


@query
def q_prompt_table(spark, sf_dir):
    return rp.prompt_table(rp.insight_payload(_segment_profile(spark, sf_dir), _rules(spark, sf_dir)))


@query
def q_analyze_summary(spark, sf_dir):
    s = analyze(retail_lines(spark, sf_dir), n_clusters=3, min_support=MIN_SUPPORT,
                min_confidence=MIN_CONFIDENCE)
    return s.select("status", "cleaned_rows", "mined_rules_count",
                    F.array_join(F.transform("top_rules", lambda r: r["rule"]), " | ").alias("top_rules_text"),
                    F.round("metrics.silhouette_score", 4).alias("silhouette_score"),
                    F.round("metrics.davies_bouldin_index", 4).alias("davies_bouldin_index"),
                    F.col("metrics.n_clusters").alias("n_clusters"), F.col("metrics.noise_count").alias("noise_count"),
                    F.col("metrics.status").alias("metrics_status"))


# ---- header normalisation and the wide basket matrix ------------------------
from tillroll.functions.schema import REQUIRED_COLUMNS, normalize_columns  # noqa: E402

# Aliased headers as an upload might carry them (trimmed and looked up at plan time).
UPLOAD_HEADERS = [" Invoice ", "SKU", "product_name", "Qty", "date", "Price", "cust-id"]


@query
def q_normalize_columns(spark, sf_dir):
    uploaded = retail_lines(spark, sf_dir).toDF(*UPLOAD_HEADERS)
    return normalize_columns(uploaded).select(*REQUIRED_COLUMNS)


# The item names of the driver's part table.
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query
def q_basket_matrix(spark, sf_dir):
    return baskets.basket_matrix(_clean(spark, sf_dir), PART_TYPES)


@query
def q_basket_vectors(spark, sf_dir):
    b = baskets.basket_vectors(_clean(spark, sf_dir))
    return b.select("InvoiceNo", "n_items", F.array_join("item_nos", ",").alias("item_nos"))


# ---- hierarchical clustering ------------------------------------------------
from tillroll.operators import agglomerative as ag  # noqa: E402

AGG_K = 3              # reference default
AGG_LINKAGE = "ward"   # reference default


@query
def q_agglomerative_labels(spark, sf_dir):
    return ag.agglomerative(_scaled(spark, sf_dir), AGG_K, AGG_LINKAGE)


@query
def q_agglomerative_complete(spark, sf_dir):
    return ag.agglomerative(_scaled(spark, sf_dir), AGG_K, "complete")


@query
def q_agglomerative_average(spark, sf_dir):
    return ag.agglomerative(_scaled(spark, sf_dir), AGG_K, "average")


# ---- metrics of clusterings that have noise or come from a model ------------
def _dbscan_points(spark, sf_dir):
    scaled = cut_lineage(_scaled(spark, sf_dir))
    return scaled.join(db.dbscan(scaled, DBSCAN_EPS, DBSCAN_MIN_SAMPLES), "CustomerID")


@query
def q_dbscan_metrics(spark, sf_dir):
    return ev.cluster_metrics(_dbscan_points(spark, sf_dir))


@query
def q_dbscan_profiles(spark, sf_dir):
    raw = _rfm(spark, sf_dir)
    labels = db.dbscan(rfm.rfm_scaled(raw), DBSCAN_EPS, DBSCAN_MIN_SAMPLES)
    return ev.cluster_profiles(raw, labels)


@query
def q_kmeans_metrics(spark, sf_dir):
    scaled = cut_lineage(_scaled(spark, sf_dir))
    return ev.cluster_metrics(scaled.join(km.kmeans(scaled, k=KMEANS_K).labels, "CustomerID"))


@query
def q_silhouette_squared(spark, sf_dir):
    return ev.silhouette_squared(_segment_points(spark, sf_dir)).select(
        F.round("silhouette_score", 4).alias("silhouette_score"))


# ---- text input ---------------------------------------------------------------
from tillroll.session import cut_lineage, ensure_checkpoint_dir, track_folder  # noqa: E402
from tillroll.sources.csv import read_retail_csv  # noqa: E402
from tillroll.sources.sinks import write_csv  # noqa: E402


def _awkward_lines(spark, sf_dir):
    """Retail lines as text, with separators, quotes, line breaks and backslashes in the descriptions."""
    k = F.col("StockCode").cast("bigint")
    d = F.col("Description")
    return retail_lines(spark, sf_dir).select(
        "InvoiceNo", "StockCode",
        F.when(k % 3 == 0, F.concat(F.lit('SET OF 6 "'), d, F.lit('", TINS')))
         .when(k % 3 == 1, F.concat(d, F.lit("\ntwo lines"))).otherwise(F.concat(d, F.lit("\\"))).alias("Description"),
        F.col("Quantity").cast("bigint").cast("string").alias("Quantity"),
        F.date_format("InvoiceDate", "yyyy-MM-dd HH:mm:ss").alias("InvoiceDate"),
        F.floor("UnitPrice").cast("string").alias("UnitPrice"), "CustomerID")


def _csv_folder(spark):
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tillroll-csv-{uuid.uuid4().hex}"
    track_folder(spark, path)
    return path


@query
def q_csv_scan(spark, sf_dir):
    """The lines written as CSV and read back."""
    path = _csv_folder(spark)
    write_csv(_awkward_lines(spark, sf_dir), path)
    return read_retail_csv(spark, path).select(*REQUIRED_COLUMNS)


@query
def q_csv_scan_latin(spark, sf_dir):
    """The same with semicolons and Latin-1 letters, written and read in that encoding."""
    path = _csv_folder(spark)
    lines = _awkward_lines(spark, sf_dir).withColumn("Description", F.concat(F.lit("crème; "), "Description"))
    write_csv(lines, path, sep=";", encoding="ISO-8859-1")
    return read_retail_csv(spark, path).select(*REQUIRED_COLUMNS)


@query
def q_clean_text_lines(spark, sf_dir):
    """Cleaning of an all-text table: four date layouts, NaN and malformed quantities."""
    k = F.col("StockCode").cast("bigint")
    raw = retail_lines(spark, sf_dir)
    text = raw.select(
        "InvoiceNo", "StockCode", "Description",
        F.when(k % 50 == 7, F.lit("NaN")).when(k % 50 == 8, F.lit("2f"))
         .otherwise(F.col("Quantity").cast("bigint").cast("string")).alias("Quantity"),
        F.when(k % 4 == 0, F.date_format("InvoiceDate", "yyyy-MM-dd HH:mm:ss.'123'"))
         .when(k % 4 == 1, F.date_format("InvoiceDate", "M/d/yyyy h:mm a"))
         .when(k % 4 == 2, F.date_format("InvoiceDate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
         .otherwise(F.date_format("InvoiceDate", "d-MMM-yyyy")).alias("InvoiceDate"),
        F.floor("UnitPrice").cast("string").alias("UnitPrice"), "CustomerID")
    return clean.clean_lines(text).select("InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate",
                                          "UnitPrice", "CustomerID", "TotalPrice")


@query
def q_clean_dayfirst_lines(spark, sf_dir):
    """Cleaning of a day-first text column, with two layouts that leave no doubt among it."""
    k = F.col("StockCode").cast("bigint")
    raw = retail_lines(spark, sf_dir)
    text = raw.withColumn("InvoiceDate", F.when(k % 5 == 0, F.date_format("InvoiceDate", "MMM d yyyy h:mm a"))
                          .when(k % 5 == 1, F.date_format("InvoiceDate", "yyyyMMdd'T'HHmmss"))
                          .otherwise(F.date_format("InvoiceDate", "d/M/yyyy H:mm")))
    return clean.clean_lines(text).select("InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate",
                                          "UnitPrice", "CustomerID", "TotalPrice")
