"""Training-data operators: deduplication, fingerprints, classifiers, mixing, chat formatting and tokenising.

Nothing else in the library imports this subpackage. Every operator takes and returns DataFrames; the queries over the
given tables are in ``queries.py``.
"""
