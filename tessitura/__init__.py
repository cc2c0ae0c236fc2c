"""Tessitura: a PySpark-native engine for nested album catalogs, ordered signals and text corpora."""
