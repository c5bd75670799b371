"""Readers, writers and the demonstration graph."""
