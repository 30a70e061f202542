"""Readers, writers and the measurement view over the test tables."""
