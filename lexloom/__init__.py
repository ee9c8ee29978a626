"""Lexloom: building, cleaning, measuring and evaluating labelled text data on Spark."""

__version__ = "0.1.0"
