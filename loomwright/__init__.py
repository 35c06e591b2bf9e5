"""Spark-native engine for training-data attribution and corpus preparation."""
