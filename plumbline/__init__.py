"""Plumbline: audit statistics for model evaluations, as Spark jobs."""
