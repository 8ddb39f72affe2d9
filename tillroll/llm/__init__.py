"""Training-data operators: dedup, toxicity, PII, tokenising, packing, search and chat repair on Spark."""
