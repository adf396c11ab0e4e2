"""Iterative plans: closures, hierarchies, chains."""
