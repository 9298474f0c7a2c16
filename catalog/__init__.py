"""Queries over the given tables, each with its SQL twin where there is one."""

from catalog.registry import ORACLES, QUERIES

from catalog import (  # noqa: E402,F401  (importing registers the queries)
    cascade_queries, corpus_queries, gate_queries, model_queries, pair_queries, replay_queries, run_queries,
    tail_queries,
)

__all__ = ["ORACLES", "QUERIES"]
