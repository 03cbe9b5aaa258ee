"""Column expressions: one value per row, no shuffles, no Python workers."""
