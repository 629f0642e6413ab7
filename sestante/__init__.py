"""Sestante: a Spark-first engine for tier-aware document search, grounding checks and corpus preparation."""

__version__ = "0.1.0"
