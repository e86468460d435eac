"""Training-data operators: counting, scoring, filtering, de-duplication, mixing and encoding of documents.

Nothing outside this subpackage imports it.
"""
