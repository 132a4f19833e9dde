"""Readers, parsers, catalog tables and sinks."""
