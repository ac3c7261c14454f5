"""Training-data operators: ten document operators and their queries.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
