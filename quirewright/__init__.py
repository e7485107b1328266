"""Spark-native curation and analytics for large collections of bibliographic records."""
