"""Spark DataFrame operators for antimicrobial-resistance surveillance data."""

__version__ = "0.1.0"
