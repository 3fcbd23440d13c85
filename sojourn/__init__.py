"""Spark-native engine for offer and price-history data."""
