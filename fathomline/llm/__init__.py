"""Operators of a training-data pipeline: text quality, duplicates, tokens, chats, pages and archives."""
