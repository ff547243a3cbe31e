"""Streams of query vectors."""
