"""Operators for preparing training data: language, dedup, toxicity, PII, tokens, packing.

Nothing outside this folder imports it. ``catalog`` registers its queries.
"""
