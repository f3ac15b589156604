"""Queries over whole pipelines, and the mapping of the test tables to transactions."""
