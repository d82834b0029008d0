"""Queries over the driver tables, each with DuckDB SQL where SQL can express it."""

from thicket.plans import (
    adaptive_queries,
    algebra_queries,
    alignment_queries,
    crossword_queries,
    family_queries,
    io_queries,
    mcts_queries,
    more_queries,
    search_queries,
    significance_queries,
    step_queries,
    text_queries,
)

_ALL = (
    search_queries,
    step_queries,
    text_queries,
    more_queries,
    family_queries,
    io_queries,
    algebra_queries,
    alignment_queries,
    mcts_queries,
    crossword_queries,
    adaptive_queries,
    significance_queries,
)
QUERIES = {name: query for part in _ALL for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _ALL for name, sql in part.ORACLES.items()}
