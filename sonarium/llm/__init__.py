"""Operators for cleaning, mixing, searching and tokenising text corpora on Spark."""
