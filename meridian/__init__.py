"""Spark-native clinical cohort and characterisation engine."""
