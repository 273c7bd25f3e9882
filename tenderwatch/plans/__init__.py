"""Stored pipeline tables, registered queries and their check SQL."""
