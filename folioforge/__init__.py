"""Folioforge: catalogue entity resolution and corpus preparation as Spark DataFrame operators."""
