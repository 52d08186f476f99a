"""Queries by area; importing this package registers them."""

from recallforge.plans import audit, engine, fulltext, graph, language, metrics, recall, retrieval, scoring, state, store, subjects, tables, text  # noqa: F401
