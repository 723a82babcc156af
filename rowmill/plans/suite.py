"""Registered queries and the DuckDB SQL each must equal."""

from . import suite_files, suite_layers, suite_rows, suite_text

_SUITES = (suite_rows, suite_text, suite_files, suite_layers)
QUERIES: dict = {k: v for s in _SUITES for k, v in s.QUERIES.items()}
ORACLE: dict = {k: v for s in _SUITES for k, v in s.ORACLE.items()}
