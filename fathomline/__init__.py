"""Spark-native analytics for file-content forensics, feature tables and file-activity streams."""
