"""Imports every query module, which registers its queries."""

from . import q_sessions, q_sequences, q_drilldown, q_ranking, q_tokens, q_evaluate, q_checks  # noqa: F401
