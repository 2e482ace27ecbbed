"""Retail sales-panel analytics as Spark jobs: clean, describe, group, check and link products."""
