"""Spark operators for durable per-key monotonic ID allocation and its control-plane data."""
