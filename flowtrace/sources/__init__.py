"""Readers and writers of transaction, feedback and alert tables."""
