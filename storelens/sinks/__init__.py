"""Output formats."""
