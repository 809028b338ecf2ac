"""Spark-native engine for office-style tables and text, and for training-data pipelines."""
