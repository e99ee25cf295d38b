"""Analytic jobs, each for all schemes or all scenarios at once."""
