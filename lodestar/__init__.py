"""Lodestar: a PySpark-native analytics engine for ranking and searching large text and source-code corpora."""
