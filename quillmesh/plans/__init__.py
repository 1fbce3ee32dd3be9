"""Named queries over the test tables, each with the equivalent DuckDB SQL."""
