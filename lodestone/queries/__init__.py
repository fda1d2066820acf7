"""Named queries over the tables of a folder, and DuckDB SQL for the same results."""
