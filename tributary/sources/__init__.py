"""Readers that turn files into evidence, and writers of results."""
