"""Streams of events and edges."""
