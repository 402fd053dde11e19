"""Operators that prepare training text: scoring, deduplication, extraction, tokens, search, packing, chats and privacy."""
