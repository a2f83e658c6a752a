"""Spark-native analytics over untrusted documents: hidden-instruction detection, scoring and clean-up."""
