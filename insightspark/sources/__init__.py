"""Readers for tables and documents, and the JSON payload sink."""
