"""DuckDB SQL of this package's queries, where SQL can express them over whole tables."""

SQL: dict[str, str] = {}
