"""Operators for building training data: secrets, language models, near copies, token files, search and sharding."""
