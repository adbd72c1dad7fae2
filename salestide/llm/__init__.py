"""Operators for large training corpora: privacy, near copies, shards, licences, languages, pages, mixtures, leaks, vectors."""
