"""Operators that prepare text corpora for training language models.

Nothing else in the library imports this package. `queries.py` lists the queries over the test
tables and the SQL to compare them with.
"""
