"""Part of tidemark, a Spark-native engine for timed-text alignment and record matching."""
