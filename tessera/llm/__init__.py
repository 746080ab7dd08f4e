"""Training-data operators: media, dedup, sharding, tokens, packing, language, URLs, archives.

Nothing outside this folder imports it.
"""
