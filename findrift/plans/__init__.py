"""Whole plans that combine the operators: comparison, corpus, adapters over plain tables."""
