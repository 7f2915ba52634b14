"""Quarrion: a multi-model analytics engine on PySpark DataFrames."""
