"""Training-data operators: ten corpus jobs that share no code with the log pipeline
beyond the session helpers. Nothing outside this folder (and ``corpus_pipeline.py``)
imports it."""
