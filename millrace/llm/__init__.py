"""Training-data operators: scoring, filtering, deduplication, decontamination and mixing.

Nothing outside this subpackage imports it; it can be removed without touching the rest.
"""
