"""Whole plans: the hierarchy, its queries and their SQL."""
