"""Relational, extraction, descriptive and feature operators."""
