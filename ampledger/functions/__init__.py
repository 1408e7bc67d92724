"""Column expressions: no job is started here and no Python runs per row."""
