"""Training-data operators over documents and pages.

Each module holds one operator with its own general interface; the registered
queries that digest their outputs are in :mod:`dialogprep.llm.queries`.
Nothing else in the library imports this subpackage.
"""
