"""Readers of markup formats, local files, and writers of corpora."""
