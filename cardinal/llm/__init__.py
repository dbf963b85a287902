"""Training-data pipeline operators (deduplication, classifiers, search, mixing, packing, language models).

Nothing outside this package imports it.  ``cardinal.llm.queries`` holds the
registered queries and their SQL.
"""
