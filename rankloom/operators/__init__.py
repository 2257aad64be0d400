"""Retrieval, ranking and evaluation operators over DataFrames."""
