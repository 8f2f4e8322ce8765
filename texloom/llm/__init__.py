"""Operators for preparing training text: sharding, language, tokens, quality, archives, search, near copies, toxicity, mixing."""
