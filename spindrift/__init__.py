"""Declarative data pipelines that compile to Spark DataFrame plans."""

__version__ = "0.1.0"
