"""Operators for large training-data pipelines: ten stages that clean, match, shard and encode a corpus.

Nothing outside this subpackage imports it. Tables are plain DataFrames with the columns of
`documents` (doc_id, text, lang, source, n_chars) or `pages` (page_id, url, html); columns beyond
those an operator names are ignored or passed through, whatever they are called.
"""
