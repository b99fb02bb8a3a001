"""Operators for preparing language-model training data: each module holds one operator, its query and, where SQL can express it, its SQL."""
