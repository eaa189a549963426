"""Tessera: DataFrame-first analytics over annotated multi-view video and event data."""
__version__ = "0.1.0"
