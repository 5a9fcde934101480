"""Queries of the engine on the test tables, each with the DuckDB SQL that it equals."""
