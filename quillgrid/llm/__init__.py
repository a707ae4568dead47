"""Operators of a training-data pipeline.

Nothing outside this package (and ``corpus_pipeline.py``) imports it. Every
operator takes a DataFrame with a text column and keeps only the columns it
names, so extra input columns, whatever they are called, never clash.
"""
