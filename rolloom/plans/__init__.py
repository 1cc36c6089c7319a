"""Whole plans, and the queries over the provided tables with their SQL twins."""
