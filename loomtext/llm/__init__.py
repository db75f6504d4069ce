"""Training-data operators: corpus-preparation operators and their queries.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
