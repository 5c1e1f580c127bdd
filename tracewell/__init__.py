"""Spark-native analytics over code facts, call graphs, coverage and snapshots."""
