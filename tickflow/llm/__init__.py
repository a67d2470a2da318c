"""Training-data operators: deduplication, scoring, mixing, tokenising, archiving.

Nothing outside this subpackage imports it.  Every module is one operator with
a general interface; ``queries`` binds them to the test tables.
"""
