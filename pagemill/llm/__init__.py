"""Operators for preparing training corpora.

Nothing outside this package imports it: the document-analytics engine works without it.
``registry`` lists the queries; every operator has a module of its own.
"""
