"""Whole runs: projection configs compiled to columns, checks of results, the engine."""
