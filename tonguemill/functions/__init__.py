"""Column functions: predicates and scalars."""
