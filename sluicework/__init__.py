"""Sluicework: a PySpark-native engine for public notices and position tables."""
