"""Training-data operators over ``documents``, ``pages``, ``embeddings`` and ``labels``.

One module per operator plus ``common`` (session set-up, stored intermediate
tables, word and shingle hashing in Arrow batches). Nothing outside this
subpackage imports it.
"""
