"""Spark-first operators for content analytics and training-data preparation."""
