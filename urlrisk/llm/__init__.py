"""Corpus operators for training data: one module each, their queries in :mod:`urlrisk.llm.queries`.

Nothing outside this folder imports it.
"""
