"""Training-data operators: deduplication, token work, packing, archives and corpus filters.

Nothing outside this folder imports it. `registry` lists its queries.
"""
