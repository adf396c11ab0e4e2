"""Data sources: Git object databases, change records."""
