"""Training-data operators: sharding, deduplication, search, archives, packing, quality and tokens.

Nothing outside this subpackage imports it. Each module holds one operator with its own general
interface; ``queries.py`` holds the registered queries and derives their digest columns.
"""
