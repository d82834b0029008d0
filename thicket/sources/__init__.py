"""Readers of example sets and logs, and writers of results."""
