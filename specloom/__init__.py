"""Specification resolution over DataFrames: pages, search results and texts in, typed attributes with provenance out."""
