"""Relational operators: votes, windows, trees, search, similarity, evaluation."""
