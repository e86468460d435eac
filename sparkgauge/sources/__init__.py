"""Readers of raw files, and writers to tables and files."""
