"""Treebank and corpus analytics as Spark DataFrame operators."""
