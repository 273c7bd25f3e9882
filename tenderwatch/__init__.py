"""Procurement-risk analytics as Spark DataFrame jobs."""
