"""Spark-native flow analytics: labelling, profiling, screening, fusion and audit of event tables."""
