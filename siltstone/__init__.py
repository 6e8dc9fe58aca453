"""Spark-native analytics over evidence-backed knowledge: claims, evidence, relations, retrieval and consolidation."""
