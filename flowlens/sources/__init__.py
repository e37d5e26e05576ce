"""Readers of the raw files and writers of the results."""
