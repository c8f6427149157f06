"""Training-data operators: scans, filters, deduplication, scoring, search and packing.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; ``queries`` holds the thin ``opN_*`` queries.
"""
