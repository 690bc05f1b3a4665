"""Corpus building, search and evaluation as Spark DataFrame operators."""
