"""Training-data operators: mixing, formatting, deduplication, sharding, tokens, quality, language, toxicity.

Nothing outside this subpackage imports it.
"""
