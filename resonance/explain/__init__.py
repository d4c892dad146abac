"""Explanations of predictions: by feature, by keyword, by word."""
