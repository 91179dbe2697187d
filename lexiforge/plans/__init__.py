"""Queries over whole tables and the whole learning plan."""
