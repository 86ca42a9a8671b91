"""Readers and writers of corpora: JSON lines, raw lines, dictionaries, shards."""
