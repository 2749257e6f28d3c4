"""Training-data operators over a ``documents``-shaped table (doc_id, text, lang, source, n_chars)."""
