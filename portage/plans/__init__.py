"""Whole runs: the migration lifecycle and the registered query suite."""
