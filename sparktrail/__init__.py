"""Spark-native analytics over agent session logs: actions in, verdicts out."""
