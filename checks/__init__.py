"""Independent DuckDB SQL for the registered queries."""
