"""Slow-query workload analytics on Spark: DataFrame in, DataFrame out."""
