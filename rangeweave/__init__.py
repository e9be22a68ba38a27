"""Spark-native engine for sequences of 3-D range scans."""
