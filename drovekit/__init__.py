"""Spark-native sample selection, trajectory analytics and evaluation."""
