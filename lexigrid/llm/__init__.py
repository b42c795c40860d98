"""Training-data operators: scans, fingerprints, deduplication, language, mixing and output.

Nothing else in the library imports this subpackage; it can be removed whole.
"""
