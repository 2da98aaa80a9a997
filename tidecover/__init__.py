"""Spark-native geo-temporal index and parametric-payout analytics."""
