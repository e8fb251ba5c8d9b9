"""Siteward: Spark-native analytics for capacity-limited access studies."""
