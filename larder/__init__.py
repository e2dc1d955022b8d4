"""Saved-content library, search and change data on Spark."""
