"""Training-data operators: deduplication, filtering, scans, search, mixing
and packing of document tables. Nothing else in the library imports this
subpackage; its registered queries are in :mod:`logweave.llm.queries`."""
