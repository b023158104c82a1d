"""Captured tables as inputs, and written outputs."""
