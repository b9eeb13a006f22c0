"""Lodestar: a Spark-native engine that ranks nested entity records and evaluates rankings."""
