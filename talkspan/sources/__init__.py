"""Readers, writers and the persisted vector table."""
