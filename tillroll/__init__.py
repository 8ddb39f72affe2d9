"""tillroll: a Spark-native retail basket and customer-segment engine.

Plain functions over PySpark DataFrames: clean raw order lines with an audit,
compute recency / frequency / monetary features, segment customers, mine
frequent itemsets and association rules, and publish profiles, rule graphs,
JSON payloads and text reports.
"""

from tillroll.session import ensure_checkpoint_dir, get_session

__all__ = ["get_session", "ensure_checkpoint_dir"]
