"""Structured Streaming forms of the detectors that work on one event at a time."""
