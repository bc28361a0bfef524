"""Composite operators and the query catalogue (Spark queries + SQL oracles)."""
