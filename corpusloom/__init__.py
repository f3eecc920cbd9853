"""Spark-native operators for document analytics and training-data preparation."""
