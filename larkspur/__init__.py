"""A Spark-native engine for cross-sectional factors and text signals."""
