"""Spark-native building, scoring and auditing of multiple-choice benchmarks."""
