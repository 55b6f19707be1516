"""Training-data operators: token counts, near-duplicate joins, extraction, classifiers, scoring."""
