"""Queries over the test tables, each with the DuckDB SQL that must give the same rows."""
