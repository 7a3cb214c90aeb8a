"""Compositions of the jobs."""
