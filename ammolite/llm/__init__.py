"""Operators that prepare training text: scans, extraction, deduplication, filtering, encoding and packing.

Nothing outside this subpackage imports it. Every operator takes DataFrames and column names, selects the
columns it needs first (so extra columns with clashing names do no harm) and returns a DataFrame.
"""
