"""Operators for building language-model training data (text and HTML filters,
deduplication, decontamination, packing). Nothing else in the library imports
this package."""
