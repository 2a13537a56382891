"""Windowed rare-event analytics on Spark: ingest, window features, count models."""

__version__ = "0.1.0"
