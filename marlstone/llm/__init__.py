"""Training-data preparation: ten operators over documents and web pages.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
