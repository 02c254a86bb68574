"""Column -> Column helpers (built-in Spark functions only, unless stated)."""
