"""Readers, raw payload sources and request planning."""
