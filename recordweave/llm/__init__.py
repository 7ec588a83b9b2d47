"""Training-data operators: mixing, token counts, quality, PII, search and dedup.

Nothing else in the library imports this subpackage.
"""
