"""Training-data operators: deduplication, language, tokens, quality, archives, media and packing.

Nothing outside this subpackage imports it; ``queries.py`` here registers its queries.
"""
