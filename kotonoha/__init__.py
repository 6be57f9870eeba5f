"""Lexicon search and text retrieval as bulk Spark jobs.

Record tables (words, kanji, names, sentences) become posting, frequency and
tag tables; a whole table of search queries is evaluated against them in one
job.  Every public function takes and returns DataFrames or Columns.
"""
