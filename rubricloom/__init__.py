"""Rubric analytics on Spark: checks, envelopes, scoring and data preparation as DataFrame transformations."""

__version__ = "0.1.0"
