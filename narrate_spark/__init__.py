"""Corpus-scale narration preparation on PySpark."""

__version__ = "0.1.0"
