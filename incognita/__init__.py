"""Spark-native reversible pseudonymisation of text: detect, map, replace, restore, audit."""
