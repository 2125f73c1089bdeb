"""Training-data operators: quality, dedup, mixing, search, scoring, PII and tokenizing.

Nothing outside this package imports it; ``queries.py`` holds the registered
queries and ``oracles.py`` their SQL.
"""
