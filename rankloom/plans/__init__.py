"""Shared planning helpers, retrievers, experiment runs and reports."""
