"""Readers and writers of logs, models and results."""
