"""Spark-native credit-loss analytics over monthly loan panels."""
