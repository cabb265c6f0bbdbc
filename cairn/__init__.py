"""Cairn: a PySpark-native engine for high-dimensional measurements and their clusterings."""
