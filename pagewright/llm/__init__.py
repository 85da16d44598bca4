"""Training-data operators: token counts, near and exact duplicates, token stores, URL
filters, source mixing, language identification, quality rules, packing, ranking, centroid
clustering, license scans and importance resampling.

Nothing else in the package imports this subpackage.
"""
