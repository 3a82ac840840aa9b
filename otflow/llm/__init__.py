"""Training-data operators: filters, scoring, deduplication, search, mixing and sharding.

Nothing outside this subpackage imports it. ``queries`` and ``oracle_sql`` list
the registered queries of :mod:`otflow.llm.entry`.
"""
