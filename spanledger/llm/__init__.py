"""Preparing message texts and report pages as training data for language models."""
