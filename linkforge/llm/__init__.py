"""Training-data operators: deduplication, mixing, scoring, filtering and tokenising of text corpora.

Nothing else in the library imports this subpackage.
"""
