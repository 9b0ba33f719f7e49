"""Composed jobs and the query registry."""
