"""Whole pipelines: the wide feature table and the tuning run."""
