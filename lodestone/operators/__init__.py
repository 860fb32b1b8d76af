"""Preparation, splits, models and evaluation."""
