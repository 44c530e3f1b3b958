"""Readers of the evidence tables and of files."""
