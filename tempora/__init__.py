"""Temporal document analytics on Spark."""
