"""Column functions with the engine's two-valued treatment of NULL."""
