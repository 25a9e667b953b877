"""Readers, writers and adapters: JSON Lines, turn tables, prompt tables."""
