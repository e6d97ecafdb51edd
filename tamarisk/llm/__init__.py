"""Training-data operators: dedup, token counts, classifiers, mixing, scoring, formatting.

Nothing else in the library imports this package; ``queries`` holds the entry points.
"""
