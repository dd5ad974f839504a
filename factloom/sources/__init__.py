"""Readers, writers and model connections."""
