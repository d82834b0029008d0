"""Thicket: reasoning-search analytics on Spark DataFrames."""
