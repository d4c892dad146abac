"""Spark ML stages, splits, metrics and tuning."""
