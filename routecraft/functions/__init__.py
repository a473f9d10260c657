"""Column-level functions: cost terms, casts and SQL function registration."""
