"""Training-data operators: sharding, joins, near-duplicates, extraction, packing, rules, tokens, archives.

Nothing outside this package imports it.  Queries live in :mod:`corpusmill.llm.queries`.
"""
