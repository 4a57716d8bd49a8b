"""Training-data operators: deduplication, decontamination, scoring, mixing, extraction, archives.

Self-contained: nothing else in the library imports this subpackage, and it can be removed whole.
"""
