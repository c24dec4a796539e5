"""Training-data operators: sharding, dedup, search, quality, decontamination, tokens, pages, chats."""
