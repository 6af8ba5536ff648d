"""Registered queries over the driver's tables, and the DuckDB SQL of each."""

from __future__ import annotations

from ammolite.plans import assemblages, builders, ecology, formats, hypotheses, isotopes, matrix, ordinations, permutation, plots, records, series, signals, spatial, spectra, stratigraphy, tables, timescales, trees, univariate

_MODULES = (ecology, assemblages, univariate, hypotheses, permutation, series, signals, stratigraphy, timescales, matrix, isotopes, records, spatial, tables, formats, trees, plots, ordinations, spectra, builders)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
