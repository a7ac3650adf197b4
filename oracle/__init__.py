"""DuckDB SQL equivalents of the registered queries, one module per topic."""
