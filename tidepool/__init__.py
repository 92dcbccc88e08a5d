"""Spark-native analytics for position-indexed events, with a corpus subpackage beside it."""
