"""Siftline: a PySpark-native engine for piped text and table queries."""
