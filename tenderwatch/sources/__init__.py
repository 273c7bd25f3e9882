"""Readers, stored tables and sinks."""
