"""Operators that prepare text corpora for training.

Each module is one operator with its own interface; :mod:`acctpulse.llm.queries`
applies them to the ``documents`` table. Nothing outside this package imports it.
"""
