"""Training-data operators over a documents table (doc_id, text, lang, source, n_chars).

Each module holds one operator with its own general interface; ``queries.py``
registers the thin ``opN_*`` queries on top of them. Nothing outside this
subpackage (and ``corpus_pipeline.py``) imports it.
"""
