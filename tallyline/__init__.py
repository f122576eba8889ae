"""Spark operators for event logs of entities, groups and periods (see README.md)."""

__version__ = "0.1.0"
