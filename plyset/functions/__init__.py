"""Predicates over slots, text forms and board geometry."""
