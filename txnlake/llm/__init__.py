"""Training-data operators: URL rules, language ID, chat formatting, search, scans, dedup.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
