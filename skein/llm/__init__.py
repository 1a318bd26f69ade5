"""Corpus-preparation operators for training data, one module each.

Every operator takes DataFrames and returns DataFrames.  Each works on whole
tables and whole texts; nothing that grows with the corpus passes through the
driver, one task or one group.  ``skein.llm.queries`` registers one query per
operator; ``corpus_pipeline.py`` chains five of them.
"""
