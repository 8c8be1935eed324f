"""Spark jobs that build, curate, encode and score corpora of vector-figure markup."""

__version__ = "0.1.0"
