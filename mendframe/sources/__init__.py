"""Readers, writers and the adaptors that derive inputs from the given tables."""
