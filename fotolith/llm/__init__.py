"""Training-data operators: language ID, quality rules and scores, near-duplicates, mixing,
packing, HTML extraction, WARC bundles, fingerprints and sharding.

Nothing outside this subpackage imports it; its queries are in :mod:`fotolith.llm.queries`.
"""
