"""Relational operators of the engine (features, as-of, matrix, scenarios, reports)."""
