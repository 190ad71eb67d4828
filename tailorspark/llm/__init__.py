"""Operators for preparing training corpora (documents, pages, benchmarks).

One module per operator, plus small shared helpers; ``queries`` holds the
registered ``opN_*`` queries and ``sql`` their DuckDB counterparts.  Nothing
outside this folder (but ``__spark_entry__`` and ``corpus_pipeline``) imports it.
"""
