"""Whole runs: operators, gates, state and evidence."""
