"""Quantitative palaeobiology and time-series analytics as plain functions from DataFrame to DataFrame."""
