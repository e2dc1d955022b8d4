"""Capture streams and their batch forms."""
