"""Spark-native document conversion and corpus analytics."""
